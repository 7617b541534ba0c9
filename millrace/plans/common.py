"""Parameters of the registered queries, scaled to the test tables' event spacing."""

from millrace.model import SECOND

PRE = 20_000
HORIZONS = (600 * SECOND, 3_600 * SECOND, 21_600 * SECOND)
GRID = 3_600 * SECOND
MAKER_BPS = 7.5
FRESH = 36_000 * SECOND
FLAT = 7.5
#: Rows of a segment beyond which it is cut.
ROWS = 1_000
