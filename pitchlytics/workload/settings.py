"""Parameters of the registered queries on the driver tables."""

YEAR = 2000
TRAIN = ("1999-01-01", "2000-09-30")
HOLD_OUT = ("2000-10-01", "2001-08-01")
MIN_BATTER, MIN_PITCHER = 5, 35

FIRST_AS_OF, SECOND_AS_OF, AS_OF = "2000-07-01", "2000-08-15", "2001-07-01"
SEASONS = tuple(
    (league, year, f"{year}-04-01", f"{year}-09-30")
    for league in ("major", "minor")
    for year in range(1995, 2002)
)

# posterior draws made up from the label indexes: chains, draws per chain, draws per block
CHAINS, DRAWS, BLOCK = 2, 50, 25
