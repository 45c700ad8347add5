"""Pure column expressions: probabilities, bands, buckets, dates, names, outcomes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_FLOOR = 1e-12
LOGIT_CLAMP = 1e-9


# -- probabilities -----------------------------------------------------------------------------------------------------


def is_probability(p: Column) -> Column:
    return p.isNotNull() & ~F.isnan(p) & p.between(0.0, 1.0)


def clamp_probability(p: Column) -> Column:
    """Into [0, 1]; what is not finite is 0.5."""
    return F.when(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")), 0.5).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(LOGIT_CLAMP)), F.lit(1 - LOGIT_CLAMP))
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def log_loss(p: Column, y: Column) -> Column:
    hit = F.when(y == 1, p).otherwise(1 - p)
    return -F.log(F.greatest(hit, F.lit(LOG_FLOOR)))


def brier(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def platt(p: Column, a: float, b: float, complement: bool = False) -> Column:
    """sigmoid(a * logit(p) + b); the complementary selection is calibrated through its opposite."""
    if complement:
        return 1 - sigmoid(a * logit(1 - p) + b)
    return sigmoid(a * logit(p) + b)


def temperature(ps: list[Column], t: float) -> list[Column]:
    """softmax(ln p / t) with p at least 1e-9."""
    scaled = [F.log(F.greatest(p, F.lit(1e-9))) / t for p in ps]
    top = F.greatest(*scaled)
    parts = [F.exp(s - top) for s in scaled]
    total = sum(parts[1:], parts[0])
    return [x / total for x in parts]


def poisson_list(rate: Column, last: int) -> Column:
    """P(0..last) of a Poisson count, each from its own closed form: no array grows."""
    log = F.log(rate)
    term = lambda k: F.exp(k * log - rate - F.lit(math.lgamma(k + 1)))
    return F.array(*[F.when(rate > 0, term(k)).otherwise(F.lit(1.0 if k == 0 else 0.0)) for k in range(last + 1)])


def poisson_terms(rate: Column, last: int) -> Column:
    """P(0..last), what lies beyond ``last`` added to it."""
    body = poisson_list(rate, last)
    tail = 1 - F.aggregate(body, F.lit(0.0), lambda a, x: a + x)
    return F.transform(body, lambda x, i: F.when(i == last, x + tail).otherwise(x))


def count_over(rate: Column, line: float) -> Column:
    """P(count > line) of a Poisson count."""
    low = F.aggregate(poisson_list(rate, int(line)), F.lit(0.0), lambda a, x: a + x)
    return clamp_probability(1 - low)


# -- bands and buckets -------------------------------------------------------------------------------------------------

# Labels and lower edges of the three odds tables. A price below the first edge has no band, but for coupons.
PREDICTION_BANDS = [
    ("1.01-1.29", 1.01),
    ("1.30-1.49", 1.30),
    ("1.50-1.79", 1.50),
    ("1.80-1.99", 1.80),
    ("2.00-2.49", 2.00),
    ("2.50+", 2.50),
]
REPORT_RANGES = [
    ("1.01_1.29", 1.01),
    ("1.30_1.49", 1.30),
    ("1.50_1.79", 1.50),
    ("1.80_1.99", 1.80),
    ("2.00_2.49", 2.00),
    ("2.50_2.99", 2.50),
    ("3.00_PLUS", 3.00),
]
COUPON_BANDS = [
    ("1.00-1.49", float("-inf")),
    ("1.50-1.99", 1.5),
    ("2.00-2.99", 2.0),
    ("3.00-4.99", 3.0),
    ("5.00-9.99", 5.0),
    ("10.00+", 10.0),
]


def ladder(value: Column, bands: list[tuple[str, float]]) -> Column:
    """The label of the band that holds ``value``: the last one whose edge it reaches; null below the first and for null."""
    out = F.when(value.isNull() | F.isnan(value), F.lit(None).cast("string"))
    for label, edge in reversed(bands):
        out = out.when(value >= edge, F.lit(label))
    return out


def bucket(p: Column) -> Column:
    """Lower bound, in points, of the five-point bin of a probability."""
    return F.least(F.greatest(F.floor(F.floor(p * 100) / 5) * 5, F.lit(0)), F.lit(95)).cast("long")


def bucket_name(p: Column) -> Column:
    return F.concat(bucket(p).cast("string"), F.lit("_"), (bucket(p) + 4).cast("string"))


def confidence_bucket(p: Column) -> Column:
    out = F.when(p < 0.5, "BELOW_50")
    for low in (50, 60, 70, 80):
        out = out.when(p < (low + 10) / 100, f"{low}_{low + 9}")
    return out.otherwise("90_100")


def sample_status(n: Column) -> Column:
    return F.when(n == 0, "INSUFFICIENT_DATA").when(n < 20, "LOW_SAMPLE").otherwise("SUFFICIENT")


# -- values ------------------------------------------------------------------------------------------------------------


def value_columns(p: Column, odd: Column) -> dict[str, Column]:
    return {"implied": 1 / odd, "edge": p - 1 / odd, "ev": p * odd - 1}


def payout_cents(stake_cents: Column, odd: Column) -> Column:
    """Half away from zero, once per payout."""
    return F.round(stake_cents * odd, 0).cast("long")


# -- dates -------------------------------------------------------------------------------------------------------------


def local_date(ts: Column, zone: str = "Europe/Istanbul") -> Column:
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def season_code(day: Column) -> Column:
    """Two-digit years of a season that starts in July, e.g. 2324."""
    start = F.year(day) - F.when(F.month(day) < 7, 1).otherwise(0)
    two = lambda y: F.lpad((y % 100).cast("string"), 2, "0")
    return F.concat(two(start), two(start + 1))


def epoch_to_timestamp(v: Column) -> Column:
    """Seconds, or milliseconds from 1e11 on; only years 2000 to 2100."""
    seconds = F.when(F.abs(v) >= 100_000_000_000, v / 1000).otherwise(v.cast("double"))
    at = F.timestamp_seconds(seconds)
    return F.when(F.year(at).between(2000, 2100), at)


def parse_kickoff(day: Column, time: Column, zone: str) -> tuple[Column, Column]:
    """(instant in UTC, whether the time was given): d/M/yyyy or d/M/yy; without a time, local noon."""
    when = F.coalesce(F.try_to_timestamp(day, F.lit("d/M/yyyy")), F.try_to_timestamp(day, F.lit("d/M/yy")))
    given = F.trim(F.coalesce(time, F.lit(""))) != ""
    clock = F.when(given, F.trim(time)).otherwise("12:00")
    local = F.try_to_timestamp(F.concat_ws(" ", F.date_format(when, "yyyy-MM-dd"), clock), F.lit("yyyy-MM-dd HH:mm"))
    return F.to_utc_timestamp(local, zone), given


# -- names -------------------------------------------------------------------------------------------------------------

# Letters folded to ASCII, words that designate a club, words that a provider adds behind a name, names that
# a provider spells in its own way, and competitions by their names in two languages.
FOLD_FROM = "áàâäãåçćčéèêëğíìîïıñóòôöõøşšúùûüýÿž"
FOLD_TO = "aaaaaaccceeeegiiiiinoooooossuuuuyyz"
DESIGNATORS = ["fc", "fk", "sk", "cf", "ac", "as", "ssc", "sv", "sc", "rc", "ado", "aj", "kaa", "krc"]
QUALIFIERS = ["city", "county", "praia", "rovers"]
TEAM_ALIASES = {
    "queens park rangers": "qpr",
    "man united": "manchester united",
    "man utd": "manchester united",
    "manchester utd": "manchester united",
    "paris sg": "paris saint germain",
    "psg": "paris saint germain",
    "psv": "psv eindhoven",
    "como 1907": "como",
    "leipzig": "rb leipzig",
    "b dortmund": "dortmund",
    "b leverkusen": "leverkusen",
    "bayern munih": "bayern munich",
    "eintracht frankfurt": "ein frankfurt",
    "fortuna sittard": "for sittard",
    "marsilya": "marseille",
    "monchengladbach": "m gladbach",
    "nec nijmegen": "nijmegen",
    "sporting lizbon": "sp lisbon",
    "vitoria guimaraes": "guimaraes",
    "braga": "sp braga",
    "n madeira": "nacional",
    "amed sportif faaliyetler": "amedspor",
    "athletic bilbao": "ath bilbao",
    "atletico madrid": "ath madrid",
    "basaksehir": "buyuksehyr",
    "celta vigo": "celta",
    "deportivo la coruna": "la coruna",
    "espanyol": "espanol",
    "goztepe": "goztep",
    "nottingham forest": "nott m forest",
    "o h leuven": "oud heverlee leuven",
    "real sociedad": "sociedad",
    "st truidense": "st truiden",
    "standard liege": "standard",
    "union saint gilloise": "st gilloise",
    "union sg": "st gilloise",
    "west bromwich": "west brom",
    "wolverhampton": "wolves",
    "zulte waregem": "waregem",
    "a de viseu": "academico viseu",
    "ipswich town": "ipswich",
    "leeds united": "leeds",
    "manchester city": "man city",
    "newcastle united": "newcastle",
    "real betis": "betis",
}
COMPETITIONS = {
    "england premier league": "premier league",
    "ingiltere premier lig": "premier league",
    "ingiltere championship": "championship",
    "ingiltere 1 lig": "league one",
    "ingiltere 2 lig": "league two",
    "ingiltere ulusal lig": "national league",
    "iskocya premiership": "scottish premiership",
    "iskocya premier lig": "scottish premiership",
    "iskocya championship": "scottish championship",
    "iskocya 1 lig": "scottish league one",
    "iskocya 2 lig": "scottish league two",
    "almanya 2 bundesliga": "2 bundesliga",
    "italya serie b": "serie b",
    "ispanya la liga 2": "la liga 2",
    "fransa ligue 2": "ligue 2",
    "yunanistan super lig": "super league greece",
    "yunanistan super league": "super league greece",
    "ispanya la liga": "la liga",
    "almanya bundesliga": "bundesliga",
    "italya serie a": "serie a",
    "fransa ligue 1": "ligue 1",
    "hollanda eredivisie": "eredivisie",
    "portekiz premier lig": "primeira liga",
    "belcika pro lig": "jupiler league",
    "turkiye super lig": "futbol ligi 1",
}


def fold_name(name: Column) -> Column:
    """Lower-case words: accents go, letters of any script and digits stay, everything else parts words."""
    out = F.replace(F.replace(F.lower(F.trim(name)), F.lit("æ"), F.lit("ae")), F.lit("ß"), F.lit("ss"))
    out = F.regexp_replace(F.translate(out, FOLD_FROM, FOLD_TO), "[\u0300-\u036f]", "")
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def strip_designators(folded: Column) -> Column:
    """Without club words in front and behind, but never without a word."""
    words = "|".join(DESIGNATORS)
    return F.regexp_replace(F.regexp_replace(folded, f"^(?:(?:{words}) )+(?=.)", ""), f"(?<=.)(?: (?:{words}))+$", "")


def strip_qualifier(folded: Column) -> Column:
    """Without the words a provider adds behind a name, but never without a word."""
    return F.regexp_replace(folded, f"(?<=.)(?: (?:{'|'.join(QUALIFIERS)}))+$", "")


def _looked_up(value: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[value]


def team_alias(key: Column, aliased: Column | None = None) -> Column:
    """The curated name for a stripped key, or null. Aliases are one provider's: ``aliased`` tells its rows; all, if not given."""
    found = _looked_up(key, TEAM_ALIASES)
    return found if aliased is None else F.when(aliased, found)


def team_key(name: Column, aliased: Column | None = None) -> Column:
    """The name by which a team is known, whatever the provider calls it."""
    key = strip_designators(fold_name(name))
    return F.coalesce(team_alias(key, aliased), key)


def competition_key(name: Column) -> Column:
    key = strip_designators(fold_name(name))
    return F.coalesce(_looked_up(key, COMPETITIONS), key)


def player_key(name: Column) -> Column:
    """Lower case, single blanks."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def content_key(*parts: Column) -> Column:
    clean = [F.trim(F.regexp_replace(F.lower(p.cast("string")), "[ \t\n]+", " ")) for p in parts]
    return F.sha2(F.concat_ws("|", *clean), 256)


# Market types by provider code, and selection labels by market, as providers and the library write them.
MARKETS = {
    1: "MATCH_RESULT",
    101: "TOTAL_GOALS",
    89: "BOTH_TEAMS_TO_SCORE",
    48: "CORNERS_TOTAL",
    92: "DOUBLE_CHANCE",
    77: "DOUBLE_CHANCE",
    4: "GOAL_RANGE",
    91: "ODD_EVEN",
    90: "HALFTIME_FULLTIME",
}
TOTALS = {"alt": "UNDER", "üst": "OVER", "ust": "OVER"}
YES = ["var", "kgvar", "karsilikligolvar", "evet", "yes", "bttsyes", "bothteamstoscoreyes"]
NO = ["yok", "kgyok", "karsilikligolyok", "hayir", "no", "bttsno", "bothteamstoscoreno"]
SELECTIONS = {
    "MATCH_RESULT": {"1": "HOME", "0": "DRAW", "x": "DRAW", "2": "AWAY"},
    "TOTAL_GOALS": TOTALS,
    "CORNERS_TOTAL": TOTALS,
    "BOTH_TEAMS_TO_SCORE": {**dict.fromkeys(YES, "YES"), **dict.fromkeys(NO, "NO")},
    "DOUBLE_CHANCE": {
        "1 ve 0": "HOME_OR_DRAW",
        "1 veya 0": "HOME_OR_DRAW",
        "1 ve 2": "HOME_OR_AWAY",
        "1 veya 2": "HOME_OR_AWAY",
        "0 ve 2": "DRAW_OR_AWAY",
        "0 veya 2": "DRAW_OR_AWAY",
    },
    "ODD_EVEN": {"tek": "ODD", "çift": "EVEN", "cift": "EVEN"},
}
CANONICAL_TOTALS = {"over": "OVER", "üst": "OVER", "ust": "OVER", "under": "UNDER", "alt": "UNDER"}
CANONICAL = {
    "MATCH_RESULT": {"home": "HOME", "draw": "DRAW", "away": "AWAY"},
    "TOTAL_GOALS": CANONICAL_TOTALS,
    "CORNERS_TOTAL": CANONICAL_TOTALS,
    "BOTH_TEAMS_TO_SCORE": {"yes": "YES", "no": "NO"},
}


def normalize_market(code: Column) -> Column:
    pairs = [F.lit(x) for pair in MARKETS.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[code.cast("int")], F.lit("UNKNOWN"))


def _by_market(market: Column, label: Column, table: dict[str, dict[str, str]]) -> Column:
    pairs = {f"{m}:{k}": v for m, names in table.items() for k, v in names.items()}
    return _looked_up(F.concat(market, F.lit(":"), label), pairs)


def normalize_selection(market: Column, raw: Column) -> Column:
    """A provider's label of a selection of a market, or null. Yes and no are read without accents and signs."""
    label = F.lower(F.trim(raw))
    plain = F.regexp_replace(F.translate(label, "ışğüöç", "isguoc"), r"[^\p{L}\p{N}]", "")
    return _by_market(market, F.when(market == "BOTH_TEAMS_TO_SCORE", plain).otherwise(label), SELECTIONS)


def canonical_selection(market: Column, raw: Column) -> Column:
    """The library's own labels, in any case."""
    return _by_market(market, F.lower(F.trim(raw)), CANONICAL)


def canonical_tuple(market: Column, raw: Column, line: Column) -> dict[str, Column]:
    """market, selection and category of a popular row, and why there is none: MARKET_NOT_SUPPORTED or UNRESOLVED."""
    provider = (
        F.when(market.isin("MATCH_RESULT", "TOTAL_GOALS"), market)
        .when(market.isin("BOTH_TEAMS_TO_SCORE", "BTTS"), "BOTH_TEAMS_TO_SCORE")
        .when(market.isin("CORNERS_TOTAL", "FULL_TIME_TOTAL_CORNERS"), "CORNERS_TOTAL")
    )
    shown = F.when(provider == "BOTH_TEAMS_TO_SCORE", "BTTS").when(provider == "CORNERS_TOTAL", "FULL_TIME_TOTAL_CORNERS").otherwise(market)
    selection = F.coalesce(normalize_selection(provider, raw), canonical_selection(provider, raw))
    category = (
        F.when((shown == "MATCH_RESULT") & selection.isNotNull() & line.isNull(), "MATCH_RESULT")
        .when((shown == "TOTAL_GOALS") & (selection == "OVER") & (line == 2.5), "OVER_25")
        .when((shown == "TOTAL_GOALS") & (selection == "OVER") & (line == 3.5), "OVER_35")
        .when((shown == "BTTS") & (selection == "YES") & line.isNull(), "BTTS_YES")
        .when((shown == "FULL_TIME_TOTAL_CORNERS") & (selection == "OVER") & line.isin(*CORNER_LINES), "CORNERS")
    )
    failure = F.when(provider.isNull(), "MARKET_NOT_SUPPORTED").when(selection.isNull(), "UNRESOLVED")
    return {"shown_market": shown, "shown_selection": selection, "category": category, "failure": failure}


# Lines of full-time corners that the models cover.
CORNER_LINES = [7.5, 8.5, 9.5, 10.5, 11.5]


def market_fold(market: Column) -> Column:
    """Both teams' totals are one market in reports."""
    return F.when(market.isin("HOME_TEAM_TOTAL_GOALS", "AWAY_TEAM_TOTAL_GOALS"), "TEAM_TOTAL_GOALS").otherwise(market)


def market_family(market: Column) -> Column:
    """The calibration family of a market: the first rule that applies."""
    return (
        F.when(market.isin("MATCH_RESULT", "BTTS", "TOTAL_GOALS"), market)
        .when(market.contains("TOTAL_GOALS"), "TEAM_TOTAL_GOALS")
        .when(market.contains("CORNERS") & market.contains("TEAM"), "TEAM_CORNERS")
        .when(market.contains("CORNERS"), "TOTAL_CORNERS")
        .when(market.contains("CARDS"), "TOTAL_CARDS")
        .otherwise("OTHER")
    )


def correlation_class(market: Column) -> Column:
    return (
        F.when(market == "FULL_TIME_TOTAL_CORNERS", "CORNERS_SAME_MATCH")
        .when(market == "TOTAL_GOALS", "NESTED_TOTAL_LINE")
        .when(market == "BTTS", "BTTS_GOALS_CORRELATION")
        .otherwise("NONE")
    )


def selection_status(category: Column) -> Column:
    return (
        F.when(category.isin("OVER_25", "BTTS_YES"), "DAILY_RANKED")
        .when(category == "HIGH_CONFIDENCE", "HIGH_CONFIDENCE")
        .when(category == "COMPOUND", "KATLAMA_ELIGIBLE")
        .otherwise("STRICT_QUALIFIED")
    )


# -- outcomes ----------------------------------------------------------------------------------------------------------


def total_outcome(total: Column, line: Column, side: Column, rule: str) -> Column:
    """WON, LOST or VOID of an over or under. The three rules differ on a push: ``backtest`` gives it to UNDER, ``report``
    to neither side, ``coupon`` makes it VOID and refuses quarter lines (null)."""
    over, under = total > line, total < line
    if rule == "backtest":
        under = total <= line
    won = F.when(side == "OVER", over).otherwise(under)
    if rule == "coupon":
        halves = line * 2 == F.floor(line * 2)
        return F.when(halves, F.when(total == line, "VOID").when(won, "WON").otherwise("LOST"))
    return F.when(won, "WON").otherwise("LOST")


def prediction_outcome(market: Column, selection: Column, line: Column, label: dict[str, Column]) -> Column:
    """Whether a prediction came true, null where that is not known: ``label`` holds hg, ag, corners, home_corners,
    away_corners and cards. A push is an UNDER; goal totals have their own lines only."""
    hg, ag = label["hg"], label["ag"]
    over = selection == "OVER"

    def side(total: Column, lines: list[float] | None = None) -> Column:
        hit = F.when(over, total > line).otherwise(total <= line)
        return F.when(line.isin(*lines), hit) if lines else hit

    result = F.when(hg > ag, "HOME").when(hg == ag, "DRAW").otherwise("AWAY")
    both = (hg > 0) & (ag > 0)
    team = lambda goals: F.when(line == 0.5, F.when(over, goals > 0.5).otherwise(goals <= 0.5)).otherwise(
        F.when(over, goals > 1.5).otherwise(goals <= 1.5)
    )
    return (
        F.when(market == "MATCH_RESULT", selection == result)
        .when(market == "BTTS", F.when(selection == "YES", both).otherwise(~both))
        .when(market == "TOTAL_GOALS", side(hg + ag, [1.5, 2.5, 3.5]))
        .when(market == "HOME_TEAM_TOTAL_GOALS", team(hg))
        .when(market == "AWAY_TEAM_TOTAL_GOALS", team(ag))
        .when(market == "FULL_TIME_TOTAL_CORNERS", side(label["corners"]))
        .when(market == "FULL_TIME_TOTAL_CARDS", side(label["cards"]))
        .when(market == "HOME_TEAM_CORNERS", side(label["home_corners"]))
        .when(market == "AWAY_TEAM_CORNERS", side(label["away_corners"]))
    )


def leg_outcome(market: Column, selection: Column, line: Column, hg: Column, ag: Column, corners: Column) -> tuple[Column, Column]:
    """(state, reason) of a coupon's leg: WON, LOST or VOID on a push, or no state and the reason why."""
    goals = market == "TOTAL_GOALS"
    totals = goals | market.isin("FULL_TIME_TOTAL_CORNERS", "CORNERS_TOTAL")
    btts = market.isin("BTTS", "BOTH_TEAMS_TO_SCORE")
    finite = line.isNotNull() & ~F.isnan(line) & (F.abs(line) < float("inf"))
    reason = (
        F.when(~(totals | btts | (market == "MATCH_RESULT")), "UNSUPPORTED_MARKET")
        .when((market == "MATCH_RESULT") & ~selection.isin("HOME", "DRAW", "AWAY"), "UNSUPPORTED_SELECTION")
        .when(btts & ~selection.isin("YES", "NO"), "UNSUPPORTED_SELECTION")
        .when(totals & ~goals & corners.isNull(), "FINAL_CORNERS_UNAVAILABLE")
        .when(totals & ~finite, "SELECTION_LINE_MISSING")
        .when(totals & ~selection.isin("OVER", "UNDER"), "UNSUPPORTED_SELECTION")
        .when(totals & (line * 2 != F.floor(line * 2)), "UNSUPPORTED_ASIAN_LINE")
    )
    total = F.when(goals, hg + ag).otherwise(corners)
    won = (
        F.when(totals, F.when(selection == "OVER", total > line).otherwise(total < line))
        .when(btts, F.when(selection == "YES", (hg > 0) & (ag > 0)).otherwise((hg == 0) | (ag == 0)))
        .otherwise(F.when(selection == "HOME", hg > ag).when(selection == "DRAW", hg == ag).otherwise(ag > hg))
    )
    state = F.when(reason.isNull(), F.when(totals & (total == line), "VOID").when(won, "WON").otherwise("LOST"))
    return state, reason
