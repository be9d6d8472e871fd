"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of tags and words. Words score positive and tags negative, each with a weight learned
from labelled pages: pages whose markup names the content itself (`article` or `main`). A tag type is its name
with its class, id and role; a word type is the tag type around it. The weight is the log-odds of standing inside
the content, clipped to the positive side for words and to the negative side for tags. One linear scan finds the
contiguous region with the largest sum; blocks of that region, without elements that are never content, are
the text. Tags and words of such elements score nothing, so that one in the midst of the content does not split it.
"""

import html
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bound of the labelled sample: about so many pages, chosen by a hash of their key and content.
LABELLED_PAGES = 2_000
WORD_FLOOR, TAG_CEILING, LIMIT = 0.02, -0.05, 8.0
NEW_WORD, NEW_TAG = 1.0, -1.0  # types that no labelled page has shown
NO_TYPE = "#document"

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg)\b(?:[^\"'>]++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:[^\"'>]++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<broken>/?[a-z][^>]*)(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)

# HTML element names by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr img".split()
)
CONTENT = frozenset(("article", "main"))
NEVER = frozenset("head title nav footer aside form button select option menu dialog fieldset object canvas audio video".split())
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar side-bar menu nav"
    " navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr popup modal newsletter subscribe signup"
    " login comment comments comment-list discussion disqus replies share sharing social related recommended".split()
)
#: Outside of named content these mean furniture of the page; inside they may name parts of the article itself.
OUTSIDE_WORDS = frozenset("banner header masthead footer notice notices overlay complementary contentinfo search".split())
CLOSED_BY = {
    "p": frozenset("p".split()), "li": frozenset("li p".split()), "dt": frozenset("dt dd p".split()),
    "dd": frozenset("dt dd p".split()), "tr": frozenset("tr td th p".split()), "td": frozenset("td th p".split()),
    "th": frozenset("td th p".split()), "option": frozenset(("option",)),
}
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol"
    " pre section table ul".split()
)


def _marks(rest):
    marks = []
    if "=" in rest:
        for _, *values in ATTRIBUTE.findall(rest):
            marks += " ".join(values).lower().split()
    return marks


def _never(name, marks, inside):
    if name in NEVER or (name == "header" and not inside):
        return True
    if name in CONTENT or name == "body":
        return False
    return any(m in NEVER_WORDS or (m in OUTSIDE_WORDS and not inside) or m.split("-")[0] in ("ad", "ads", "cookie") for m in marks)


def tokens(page):
    """Yield (kind, type, value, in_content, dropped): tags with their type, texts with the type around them.

    kind is "tag", "block" (a tag that separates blocks) or "text". `in_content` is True inside `article` or
    `main`, `dropped` inside an element that is never content and for its own tags. Unclosed and misnested elements are closed as
    browsers do for paragraphs, items and cells; a tag cut off by the end of the page counts as a tag.
    """
    stack = []  # (name, type, in_content, dropped, place of the nearest entry that is not inline)
    opened = Counter()  # how often each name is on the stack
    kind, inside, dropped, at = NO_TYPE, False, False, 0

    def top():
        return stack[-1][1:4] if stack else (NO_TYPE, False, False)

    def cut(place):
        for entry in stack[place:]:
            opened[entry[0]] -= 1
        del stack[place:]

    for match in TOKEN.finditer(page):
        if match.start() > at:
            yield "text", kind, page[at : match.start()], inside, dropped
        at = match.end()
        name = match["name"]
        if not name:
            continue  # comments, declarations and elements without text
        name = name.lower()
        block = name not in INLINE
        if match["close"]:
            own_dropped = False
            if opened[name]:
                while stack[-1][0] != name:
                    cut(-1)
                own_dropped = stack[-1][3]
                cut(-1)
            kind, inside, dropped = top()
            yield ("tag" if name == "br" or not block else "block"), "/" + name, "", inside, dropped or own_dropped
            continue
        closed = CLOSED_BY.get(name) or (CLOSED_BY["p"] if name in ENDS_PARAGRAPH else ())
        if closed:
            while stack and (place := stack[-1][4]) >= 0 and stack[place][0] in closed:
                cut(place)
            kind, inside, dropped = top()
        marks = _marks(match["rest"])
        own = ".".join([name, *marks])
        if name in VOID or match["rest"].endswith("/"):
            yield ("tag" if name == "br" or not block else "block"), own, " " if name == "br" else "", inside, dropped
            continue
        dropped = dropped or _never(name, marks, inside)
        yield ("block" if block else "tag"), own, "", inside, dropped
        inside = inside or name in CONTENT
        if block or marks or name == "a":
            kind = own
        stack.append((name, kind, inside, dropped, len(stack) if block else stack[-1][4] if stack else -1))
        opened[name] += 1
    if at < len(page):
        yield "text", kind, page[at:], inside, dropped


def type_counts(page):
    """Counts of (is word, type, inside content) of a labelled page; None where the markup names no content."""
    counts, labelled = Counter(), False
    for kind, own, value, inside, dropped in tokens(page):
        labelled |= inside
        if kind == "text":
            if words := len(html.unescape(value).split()):
                counts[True, own, inside and not dropped] += words
        elif not dropped:
            counts[False, own, inside] += 1
    return counts if labelled else None


def learn_weights(counts):
    """Weights of word and tag types from summed counts of labelled pages."""
    total = {inside: 1 + sum(n for (_, _, i), n in counts.items() if i == inside) for inside in (True, False)}
    weights = {}
    for word, own in {key[:2] for key in counts}:
        odds = math.log((counts[word, own, True] + 0.5) / total[True]) - math.log((counts[word, own, False] + 0.5) / total[False])
        odds = max(-LIMIT, min(LIMIT, odds))
        weights[word, own] = max(WORD_FLOOR, odds) if word else min(TAG_CEILING, odds)
    return weights


def best_region(scores):
    """(start, end) of the contiguous run with the largest positive sum, the first of equals; (0, 0) without one."""
    best, region, running, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if running <= 0:
            running, start = 0.0, i
        running += score
        if running > best:
            best, region = running, (start, i + 1)
    return region


def extract(page, weights):
    """Text of the best region: one line per block, entities decoded, white space collapsed."""
    if not page:
        return ""
    parts, scores = [], []
    for kind, own, value, _, dropped in tokens(page):
        text = html.unescape(value) if kind == "text" else value
        if dropped:
            score = 0.0
        elif kind != "text":
            score = weights.get((False, own), NEW_TAG)
        else:
            score = weights.get((True, own), NEW_WORD) * len(text.split())
        parts.append((kind, text, dropped))
        scores.append(score)
    start, end = best_region(scores)
    blocks, block = [], []
    for kind, text, dropped in parts[start:end]:
        if kind == "block":
            blocks.append("".join(block))
            block = []
        elif not dropped:
            block.append(text)
    blocks.append("".join(block))
    return "\n".join(line for line in (" ".join(block.split()) for block in blocks) if line)


def fit_weights(pages, labelled_pages=LABELLED_PAGES):
    """Weights from a bounded hash sample of the pages whose markup names the content.

    The sample is cut to size by the share that a first scan of the markup measures; only type counts of the
    sampled pages reach the driver.
    """
    named = pages.where(F.lower("html").rlike("<(article|main)[\\s>]"))
    n = named.count()
    chance = F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 30)) / float(1 << 30)
    sample = named.where(chance < min(1.0, labelled_pages / n) if n else F.lit(False)).select("html")

    def count(batches):
        total = Counter()
        for batch in batches:
            for page in batch["html"]:
                total.update(type_counts(page) or {})
        yield pd.DataFrame([(*key, n) for key, n in total.items()], columns=["word", "own", "inside", "n"])

    schema = "word boolean, own string, inside boolean, n long"
    rows = sample.mapInPandas(count, schema).groupBy("word", "own", "inside").agg(F.sum("n").alias("n")).collect()
    return learn_weights(Counter({(r["word"], r["own"], r["inside"]): r["n"] for r in rows}))


def main_text(pages, weights):
    """Per page: page_id, url, text and n_chars, of the whole page in time proportional to its length.

    Null or empty html gives an empty text; repeated rows stay repeated; extra columns are ignored; an empty table
    gives no rows.
    """

    @F.pandas_udf(T.StringType())
    def content(pages_html: pd.Series) -> pd.Series:
        return pages_html.map(lambda page: extract(page, weights))

    found = pages.select("page_id", "url", content("html").alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
