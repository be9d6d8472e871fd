"""Equi-joins with a table of one row per key, where some keys may hold a large share of the rows."""

from gridtide.functions.sizes import broadcast_within

#: A key with so many rows is looked up apart from the others; fewer rows of one key do no harm in one task.
HOT = 4096


def looked_up(rows, table, key, count):
    """`rows` inner joined with `table` on `key`; `table` has one row per key and the number of its rows in `count`.

    The few keys with at least `HOT` rows (at most one in `HOT` rows can name another one) are broadcast when their
    measured size allows it, so that their rows stay where they are. All others are shuffled, with under `HOT`
    rows a key. Beyond the broadcast bound adaptive execution has to split the heavy keys.
    """
    table = table.withColumnRenamed(count, "_rows")
    hot = broadcast_within(table.where(f"_rows >= {HOT}").drop("_rows"))
    rest = table.where(f"_rows < {HOT}").drop("_rows")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))
