"""Fixed values of the scoring model and of the daily process."""

# --- fixed values -----------------------------------------------------------
# Order in which the weighted features are added up.
WEIGHTED = ("gpg", "five_gpg", "hgpg", "tgpg", "otga", "hppg_otshga", "is_home")

# Features that are min-max normalised, with their fixed bounds.
BOUNDS = {
    "gpg": (0.0, 2.0),
    "hgpg": (0.0, 2.0),
    "five_gpg": (0.0, 2.0),
    "tgpg": (0.0, 4.0),
    "otga": (0.0, 4.0),
    "otshga": (0.0, 1.12),
    "hppg": (0.0, 0.314),
}

WEIGHTS = {
    "gpg": 0.19,
    "five_gpg": 0.06,
    "hgpg": 0.60,
    "tgpg": 0.11,
    "otga": 0.04,
    "hppg_otshga": 0.0,
    "is_home": 0.0,
}

# Columns a training row must have.
TRAINING_FEATURES = ("gpg", "hgpg", "five_gpg", "tgpg", "otga", "hppg", "otshga", "home")

TIERS = (1, 2, 3)
RETENTION_DAYS = 8  # includes the current day
SEASON_START = "2025-10-07"
HOME_ZONE = "America/Toronto"
METRIC_ID = "current_pick_accuracy"

PERIOD_SECONDS = 1200
RECENT_GOAL_SECONDS = 60
LIVE_STATES = ("LIVE", "CRIT", "FINAL")
POLL_INTERVAL = "15 seconds"

ODDS_PROVIDER = 2
ODDS_CATEGORY = "Goalscorer"
ODDS_LABEL = "Anytime Goalscorer"
MINIMUM_BET = 0.1
BANKROLL = 100.0
IGNORED_NAMES = ("Brendan Brisson",)

# Ordered substring replacements that bring odds names to roster names.
NAME_ALIASES = (
    ("Cam", "Cameron"),
    ("J.J. Moser", "Janis Moser"),
    ("Pat Maroon", "Patrick Maroon"),
    ("T.J. Brodie", "TJ Brodie"),
    ("Mitchell Marner", "Mitch Marner"),
    ("Alex Wennberg", "Alexander Wennberg"),
    ("Tim Stuetzle", "Tim Stutzle"),
    ("Zach Aston-Reese", "Zachary Aston-Reese"),
    ("Nicholas Paul", "Nick Paul"),
    ("Matt Dumba", "Mathew Dumba"),
    ("Alex Kerfoot", "Alexander Kerfoot"),
    ("Josh Mahura", "Joshua Mahura"),
    ("Elias-Nils Pettersson", "Elias Pettersson"),
)

LEDGER_COLUMNS = (
    "Date",
    "Name",
    "Team",
    "My Probability",
    "DraftKings Probability",
    "DraftKings Odds",
    "Bet Size",
    "Payout Amount",
    "Scored",
)
# ----------------------------------------------------------------------------

# Largest number of rows of one group that a single task handles as a unit.
MAX_GROUP_ROWS = 100_000
