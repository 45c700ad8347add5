"""Bulletins of unknown depth: event and competition objects wherever they are, and what is wrong with the rest, as rows.

A document is a VARIANT. The walk goes down a level of all documents at a time: nodes that are wanted are kept and not entered,
the others are exploded into their children, until no container is left; so a level is one generator over rows of all
documents, ``LEVELS`` of them make one stage, and depth costs stages, not recursion in a row. Nothing asks for the schema of
a whole subtree, which would read it again at every level. An object with a field of a wrong type is a row with an issue: it
costs neither its document nor its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.session import checkpointed

# Fields by type, as the provider names them, and the spellings of a competition's.
WHOLE, TEXT, FLAG, NUMBER = "whole", "text", "flag", "number"
EVENT = {"i": WHOLE, "hn": TEXT, "an": TEXT, "sid": WHOLE, "ci": WHOLE, "d": WHOLE, "mbc": WHOLE, "kOdd": FLAG}
MARKET = {"i": WHOLE, "t": WHOLE, "st": WHOLE, "sov": TEXT, "mbc": WHOLE}
SELECTION = {"no": WHOLE, "n": TEXT, "odd": NUMBER, "wodd": NUMBER}
COMPETITION = {"id": ["i", "id"], "name": ["n", "name"], "country": ["country", "countryName", "cn"], "season": ["season"]}
FOOTBALL = 1
#: Levels that are gone down before what is left is written.
LEVELS = 8

SQL_TYPE = {WHOLE: "bigint", TEXT: "string", FLAG: "boolean", NUMBER: "double"}
#: Types of a variant's value that a field may have; VOID is JSON's null.
ALLOWED = {WHOLE: "^(BIGINT|VOID)$", TEXT: "^(STRING|VOID)$", FLAG: "^(BOOLEAN|VOID)$", NUMBER: r"^(BIGINT|DOUBLE|DECIMAL.*|VOID)$"}


def _kind(node: Column, path: str) -> Column:
    """The type of what is at the path; null where nothing is."""
    return F.schema_of_variant(F.try_variant_get(node, path, "variant"))


def _has(node: Column, *names: str) -> Column:
    there = F.lit(False)
    for name in names:
        there = there | F.try_variant_get(node, f"$.{name}", "variant").isNotNull()
    return there


def _wrong(node: Column, fields: dict[str, str]) -> Column:
    """The first field of a wrong type, or null."""
    return F.coalesce(*[F.when(~_kind(node, f"$.{name}").rlike(ALLOWED[kind]), name) for name, kind in fields.items()])


def _list(node: Column, name: str) -> Column:
    return F.try_variant_get(node, f"$.{name}", "array<variant>")


def _wrong_list(node: Column, name: str) -> Column:
    return F.when(_has(node, name) & _list(node, name).isNull(), name)


def documents(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(doc, node): null where the text is no JSON. Parsed once: every walk begins at what is written here."""
    return checkpointed(rows.select(F.col(key).alias("doc"), F.try_parse_json(F.col(body)).alias("node")))


def walk(docs: DataFrame, wanted: Column, skipped: list[str]) -> DataFrame:
    """(doc, node): every object for which ``wanted`` (over ``node``) holds, outside the members named in ``skipped``."""
    items, members = (F.try_variant_get("node", "$", kind) for kind in ("array<variant>", "map<string,variant>"))
    if skipped:
        members = F.map_filter(members, lambda name, _: ~name.isin(skipped))
    inside = F.coalesce(items, F.map_values(members))  # null for what is no container
    level, found = docs.filter("node IS NOT NULL").select("doc", "node"), None
    while True:
        level = level.withColumn("_found", F.lit(False))
        for _ in range(LEVELS):
            level = level.withColumn("_found", F.col("_found") | wanted)
            level = level.select("doc", "_found", F.explode(F.when(F.col("_found"), F.array("node")).otherwise(inside)).alias("node"))
        level = checkpointed(level.filter(F.col("_found") | (F.size(inside) > 0)))
        kept = level.filter("_found").select("doc", "node")
        found = kept if found is None else found.unionByName(kept)
        level = level.filter("NOT _found").select("doc", "node")
        if level.isEmpty():
            return found


def events(docs: DataFrame) -> DataFrame:
    """(doc, event_id, home, away, sport, competition, at, markets, issue): every event object; ``issue`` names the first field
    of a wrong type, in the event or below it, and leaves the other columns null. A document without JSON, or without any event,
    is one row with an issue."""
    node = F.col("node")
    found = walk(docs, _has(node, "i") & _has(node, "hn", "an"), ["competitions"])
    markets = _list(node, "m")

    def in_market(m: Column) -> Column:
        return F.coalesce(_wrong(m, MARKET), _wrong_list(m, "o"), _first(_list(m, "o"), lambda s: _wrong(s, SELECTION)))

    def _first(items: Column, wrong) -> Column:
        return F.get(F.filter(F.transform(items, wrong), lambda x: x.isNotNull()), F.lit(0))

    issue = F.coalesce(_wrong(node, EVENT), _wrong_list(node, "m"), _first(F.when(F.size(markets) > 0, markets), in_market))
    typed = found.withColumn("issue", F.when(issue.isNotNull(), F.concat(F.lit("MALFORMED:"), issue)))
    get = lambda name: F.when(F.col("issue").isNull(), F.try_variant_get(node, f"$.{name}", SQL_TYPE[EVENT[name]]))
    good = typed.select(
        "doc", get("i").alias("event_id"), get("hn").alias("home"), get("an").alias("away"), get("sid").alias("sport"), get("ci").alias("competition"), get("d").alias("at"),
        F.when(F.col("issue").isNull(), markets).alias("markets"), "issue",
    )
    empty = docs.join(found.select("doc").distinct(), "doc", "left_anti")
    bare = empty.select("doc", F.when(F.col("node").isNull(), "MALFORMED_JSON").otherwise("NO_EVENTS").alias("issue"))
    return good.unionByName(bare, allowMissingColumns=True)


def competitions(docs: DataFrame) -> DataFrame:
    """(competition, name, country, season): competition objects anywhere, under any spelling of their fields; ones without an
    id or a name, or with a field of a wrong type, are left out; of several with one id, the one of the largest document, then
    name, stays."""
    node = F.col("node")
    found = walk(docs, _has(node, *COMPETITION["id"]) & _has(node, *COMPETITION["name"]), [])
    fields = {spelling: WHOLE if name == "id" else TEXT for name, spellings in COMPETITION.items() for spelling in spellings}
    got = lambda name: F.coalesce(*[F.try_variant_get(node, f"$.{x}", SQL_TYPE[fields[x]]) for x in COMPETITION[name]]).alias(name)
    rows = found.filter(_wrong(node, fields).isNull()).select("doc", *[got(name) for name in COMPETITION]).filter("id IS NOT NULL AND trim(name) <> ''")
    last = rows.groupBy("id").agg(F.max(F.struct("doc", "name", "country", "season")).alias("c"))
    return last.select(F.col("id").alias("competition"), "c.name", "c.country", "c.season")


def import_status(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` (from ``events``) with ``status``: IMPORTED, UNRESOLVED_COMPETITION where ``known`` lacks it, or REJECTED with the
    first thing that an event must have and lacks as its ``issue``. One event's fault is its own."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    lacks = (
        F.when(F.col("issue").isNotNull(), F.col("issue"))
        .when(F.col("event_id").isNull(), "MISSING:i")
        .when(F.coalesce(F.col("sport"), F.lit(FOOTBALL)) != FOOTBALL, "NOT_FOOTBALL")
        .when(F.col("competition").isNull(), "MISSING:ci")
        .when(text("home") == "", "MISSING:hn")
        .when(text("away") == "", "MISSING:an")
        .when(text("home") == text("away"), "SAME_TEAMS")
        .when(F.col("at").isNull(), "MISSING:d")
    )
    rows = found.withColumn("issue", lacks).join(known.select("competition", F.lit(True).alias("_known")), "competition", "left")
    status = F.when(F.col("issue").isNotNull(), "REJECTED").when(F.col("_known"), "IMPORTED").otherwise("UNRESOLVED_COMPETITION")
    return rows.withColumn("status", status).drop("_known")


def outcomes(imported: DataFrame) -> DataFrame:
    """(event_id, market_id, market_code, line, outcome, name, odd): the priced selections of imported events."""
    m, o = F.col("m"), F.col("o")
    rows = imported.filter("status = 'IMPORTED'").select("event_id", F.explode("markets").alias("m"))
    sov = F.try_variant_get(m, "$.sov", "string").try_cast("double")
    rows = rows.select("event_id", F.try_variant_get(m, "$.i", "bigint").alias("market_id"), F.try_variant_get(m, "$.st", "bigint").alias("market_code"), sov.alias("line"), F.explode(F.try_variant_get(m, "$.o", "array<variant>")).alias("o"))
    get = lambda name: F.try_variant_get(o, f"$.{name}", SQL_TYPE[SELECTION[name]])
    rows = rows.select("event_id", "market_id", "market_code", "line", get("no").alias("outcome"), F.trim(get("n")).alias("name"), get("odd").alias("odd"))
    return rows.filter((F.col("name") != "") & (F.col("odd") > 0) & (F.col("odd") < float("inf")))
