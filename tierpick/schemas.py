"""Declared schemas of the landed feeds and of the tables."""

_TEAM = (
    "struct<id: bigint, placeName: struct<default: string>, abbrev: string, "
    "commonName: struct<default: string>>"
)
SCHEDULE = (
    "gameWeek array<struct<games: array<struct<startTimeUTC: string, season: string, "
    f"homeTeam: {_TEAM}, awayTeam: {_TEAM}>>>>"
)

_SKATER = (
    "struct<id: bigint, firstName: struct<default: string>, lastName: struct<default: string>>"
)
ROSTER = f"forwards array<{_SKATER}>, defensemen array<{_SKATER}>"

SCORE = (
    "games array<struct<gameScheduleState: string, gameOutcome: struct<lastPeriodType: string>, "
    "homeTeam: struct<abbrev: string>, awayTeam: struct<abbrev: string>, "
    "goals: array<struct<playerId: bigint>>>>"
)

TIER_LISTS = "playerLists array<struct<players: array<struct<nhlPlayerId: bigint>>>>"

INJURIES = "player string, injury string, status string"

ODDS = (
    "eventGroup struct<offerCategories: array<struct<name: string, "
    "offerSubcategoryDescriptors: array<struct<name: string, offerSubcategory: struct<"
    "offers: array<array<struct<label: string, outcomes: array<struct<providerId: int, "
    "playerNameIdentifier: string, participant: string, oddsAmerican: string>>>>>>>>>>>"
)

_BOARD_TEAM = (
    "struct<abbrev: string, score: int, placeNameWithPreposition: struct<default: string>>"
)
SCOREBOARD = (
    "gamesByDate array<struct<date: string, games: array<struct<id: bigint, gameState: string, "
    f"awayTeam: {_BOARD_TEAM}, homeTeam: {_BOARD_TEAM}, periodDescriptor: struct<number: int>, "
    "clock: struct<timeRemaining: string, secondsRemaining: int, inIntermission: boolean>>>>>"
)

GAME_STORY = (
    "summary struct<scoring: array<struct<periodDescriptor: struct<number: int>, "
    "goals: array<struct<name: struct<default: string>, firstName: struct<default: string>, "
    "lastName: struct<default: string>, teamAbbrev: struct<default: string>, "
    "timeInPeriod: string>>>>>"
)

BOARD = (
    "id bigint, player_id bigint, name string, date date, gpg double, hgpg double, "
    "five_gpg double, stat double, tims int, team_name string, tgpg double, otga double, "
    "injury_status string, injury_desc string"
)
HISTORY = (
    "id bigint, player_id bigint, name string, date date, gpg double, hgpg double, "
    "five_gpg double, stat double, tims int, team_name string, tgpg double, otga double, "
    "Scored int"
)
METRIC = "id string, date date, value double, correct bigint, total bigint"

# What labelling needs of the archive.
ARCHIVE = "date date, id bigint, team_abbr string, scored int"
