"""Wording of reasons and messages that other tools read back."""

# Outcome of the per-file checks.
NO_ROWS = "File contains zero data rows"
BAD_TIME = "Malformed timestamp values: "
NO_CELL = "Missing CellID values: "
NOT_NUMERIC = "Non-numeric values found in activity column '{name}': "
NEGATIVE = "Negative activity values found in '{name}': "
CHECKS_PASSED = "Minimum quality checks passed"

# Outcome of the header check.
SCHEMA_MISMATCH = "Schema mismatch. Expected columns: {expected}; Found: "
UNREADABLE = "Unable to read CSV schema: file is empty"
RAGGED = "Quality validation failed: rows with more fields than the header: "

# Wording of an alert reason.
ALERT_START = "current activity "
AGAINST_BASELINE = "the grid's within-day median baseline"
AGAINST_PREVIOUS = "the immediately preceding hour's activity"

# Data-quality and health messages.
MISSING_FEATURES = "Missing feature values: "
LAYERS_IN_STEP = "Features and alerts are synchronized with raw activity."
LAYERS_LAG = "Minor pipeline lag detected between raw ingestion and feature computation."

BASELINE_LIMITATIONS = """# Limits of the within-day baseline

- The baseline of an hour is the median of the other hours of the same cell and the same day. It knows
  nothing about other days, so the daily rhythm itself raises alerts: night hours tend to be drops and
  busy hours tend to be highs.
- Days without all 24 hours get no baseline and raise neither HIGH_ACTIVITY nor ACTIVITY_DROP.
- Cell days whose total is below the activity floor are left out of all three rules.
- ACTIVITY_SPIKE compares with the previous row of the same day, which is the previous hour only when no
  hour is missing; the first row of a day has nothing to compare with.
- A day that is unusual as a whole raises no alert, because its own hours are the yardstick.
- An alert says that activity differs, not why: events, outages, holidays and faulty records look alike.
- False alerts are uneven: quiet cells and cells with a strong daily rhythm raise more than steady ones.
- A baseline rests on 23 values of one day, so a few odd hours can move it.
- Neighbouring cells share causes; their alerts are not independent and must not be counted as such.
- One hour can carry alerts of several rules; the number of alerts is not the number of odd hours.
- Missing or repeated source records change totals and can raise alerts of their own.
"""
