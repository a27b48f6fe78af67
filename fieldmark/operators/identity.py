"""Who is who across sources: cascades of equi joins, each fed what the one before left over."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.columns import top
from fieldmark.functions.names import CLUBS, NO_CLUB, blank_to_null
from fieldmark.sources.settled import settle


def _named(hub: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys (with ``_`` before their names) that are not null and that one hub row has, and its player as ``_player``."""
    known = hub.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    once = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("player_id").alias("_player")).filter("_n = 1")
    return once.select(*[F.col(k).alias(f"_{k}") for k in keys], "_player")


def _step(left: DataFrame, hub: DataFrame, on: Sequence[str], how: str) -> tuple[DataFrame, DataFrame]:
    """(matched, remainder) of joining source rows to hub rows that the keys name without doubt."""
    cond = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in on])
    joined = left.join(_named(hub, on), cond, "left")
    got = joined.filter(F.col("_player").isNotNull()).select(*left.columns, F.col("_player").alias("player_id"), F.lit(how).alias("matched_by"))
    return got, joined.filter(F.col("_player").isNull()).select(*left.columns)


def crosswalk(source: DataFrame, hub: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Source rows with the player they are and how that was found.

    Ids in order of priority, then name, team and position, then name and position where only one player has them;
    what is left is unlinked (null player, ``new``). ``source`` has source_id, the ids, name_norm, team, position."""
    steps = [([i], f"id:{i}") for i in ids] + [(["name_norm", "team", "position"], "name_team_pos"), (["name_norm", "position"], "name_pos")]
    rows = source.withColumns({"player_id": F.lit(None).cast("long"), "matched_by": F.lit("new")})
    for on, how in steps:  # one row set goes through all steps; only rows that have no player yet are joined
        cond = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in on], F.col("player_id").isNull())
        rows = rows.join(_named(hub, on), cond, "left")
        now = {"player_id": F.coalesce("player_id", "_player"), "matched_by": F.when(F.col("_player").isNotNull(), how).otherwise(F.col("matched_by"))}
        rows = rows.withColumns(now).select(*source.columns, "player_id", "matched_by")
    return rows


def crosswalk_all(sources: Sequence[tuple[str, DataFrame, Sequence[str]]], hub: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links of every source, hub with the ids that sources brought): later sources match by what earlier ones added.

    A link adds an id only where the hub has none, and nobody joins the hub; see :func:`grow_hub` for that."""
    links = []
    for name, source, ids in sources:
        got = crosswalk(source, hub, ids)
        links.append(got.select(F.lit(name).alias("source"), "source_id", "player_id", "matched_by"))
        new = top(got.filter(F.col("player_id").isNotNull()), ["player_id"], [F.asc("source_id")])
        brought = new.select(F.col("player_id").alias("_p"), *[F.col(i).alias(f"_{i}") for i in ids])
        hub = hub.join(brought, F.col("player_id") == F.col("_p"), "left").drop("_p")
        hub = hub.withColumns({i: F.coalesce(i, f"_{i}") for i in ids}).drop(*[f"_{i}" for i in ids])
    return reduce(lambda a, b: a.unionByName(b), links), hub


#: What every row of a hub has besides its ids.
PERSON = ("name", "name_norm", "position", "team")


@dataclass(frozen=True)
class Source:
    """Rows of one source: ``place`` (their order, unique), the ids, and name, name_norm, position and team.

    ``ids`` are looked up in their order, and all of them are handed to the hub. ``registry``, if given, knows people by
    ``own_id``: what finds nobody takes gsis_id, name and name_norm from there when it has him."""

    name: str
    rows: DataFrame
    ids: Sequence[str]
    own_id: str | None = None
    registry: DataFrame | None = None


def hub_key(gsis_id: Column, position: Column, team: Column, name_norm: Column) -> Column:
    """A person's key: his league id, a defence's team, or name and position of those without an id."""
    return F.when(position == "DEF", F.concat(F.lit("DEF:"), F.coalesce(team, F.lit("")))).otherwise(F.coalesce(gsis_id, F.concat(F.lit("name:"), name_norm, F.lit("|"), position)))


def new_hub(roster: DataFrame, ids: Sequence[str], name: str) -> DataFrame:
    """A hub of the people of a roster (``place``, gsis_id, other ids, and who they are), the first row of each key."""
    cols = [*PERSON, *dict.fromkeys(["gsis_id", *ids])]
    known = roster.withColumn("hub_key", hub_key(*(F.col(c) for c in ("gsis_id", "position", "team", "name_norm")))).filter(F.col("hub_key").isNotNull())
    seq = F.struct(F.lit(0).alias("source"), F.col("place").cast("long").alias("place"))
    first = [F.min_by(blank_to_null(F.col(c).cast("string")), F.when(blank_to_null(F.col(c).cast("string")).isNotNull(), F.col("place"))).alias(c) for c in cols]
    return known.groupBy("hub_key").agg(F.min(seq).alias("seq"), *first, F.create_map(F.lit(name), F.lit("gsis_id")).alias("match_sources"))


def _looked_up(rows: DataFrame, hub: DataFrame, on: Sequence[str], alone: bool, name: str) -> DataFrame:
    """``rows`` with a column ``name``: the hub row of the same values ``on``, the first of several, or only if it is ``alone``.

    Rows that lack a value get a key of their own, so nulls do not meet in one task."""
    all_there = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in on])
    value = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in on])
    index = hub.filter(all_there).groupBy(value.alias("_v")).agg(F.min_by("hub_key", "seq").alias(name), F.count("*").alias("_n"))
    index = index.filter("_n = 1") if alone else index
    asked = rows.withColumn("_q", F.when(all_there, value).otherwise(F.concat(F.lit("\u0002"), F.col("place").cast("string"))))
    return asked.join(index.drop("_n"), F.col("_q") == F.col("_v"), "left").drop("_q", "_v")


def find_in_hub(source: Source, hub: DataFrame) -> DataFrame:
    """The source's rows with ``hub_key`` and ``how`` it was found: a defence by its team, then by ids in order, by name, team
    and position, by name and position where one hub row has them; else as somebody new."""
    rows = source.rows
    for i in source.ids:
        rows = _looked_up(rows, hub.select("hub_key", "seq", i), [i], False, f"_{i}")
    rows = _looked_up(rows, hub, ["name_norm", "team", "position"], False, "_team")
    rows = _looked_up(rows, hub, ["name_norm", "position"], True, "_name")
    gsis = F.lit(None).cast("string")
    if source.registry is not None:
        r = source.registry.filter(F.col(source.own_id).isNotNull()).groupBy(F.col(source.own_id).cast("string").alias("_own")).agg(
            F.min(F.struct("gsis_id", "name", "name_norm")).alias("_r")
        )
        asked = F.coalesce(F.col(source.own_id).cast("string"), F.concat(F.lit("\u0002"), F.col("place").cast("string")))
        rows = rows.join(r, asked == F.col("_own"), "left")
        gsis = F.col("_r.gsis_id")
    found = [(F.when(F.col("position") == "DEF", hub_key(gsis, F.col("position"), F.col("team"), F.col("name_norm"))), "def:team")]
    found += [(F.col(f"_{i}"), f"id:{i}") for i in source.ids] + [(F.col("_team"), "name+team+pos"), (F.col("_name"), "name+pos")]
    if source.registry is not None:
        found.append((F.when(F.col("_r").isNotNull(), hub_key(gsis, F.col("position"), F.col("team"), F.coalesce("_r.name_norm", "name_norm"))), f"registry:{source.own_id}"))
    found.append((hub_key(F.lit(None).cast("string"), F.col("position"), F.col("team"), F.col("name_norm")), "new"))
    how = F.coalesce(*[F.when(k.isNotNull(), F.lit(w)) for k, w in found])
    new = F.startswith(how, F.lit("registry:"))
    own = {"gsis_id": gsis, **({c: F.coalesce(F.when(new, F.col(f"_r.{c}")), F.col(c)) for c in ("name", "name_norm")} if source.registry is not None else {})}
    extra = {"gsis_id": F.when(new, gsis)} if "gsis_id" not in source.rows.columns else {}
    out = rows.withColumns({"hub_key": F.coalesce(*[k for k, _ in found]), "how": how, **extra, **{c: e for c, e in own.items() if c != "gsis_id"}})
    return out.select(*source.rows.columns, *extra, "hub_key", "how").filter(F.col("hub_key").isNotNull())


def grow_hub(hub: DataFrame, sources: Sequence[Source]) -> tuple[DataFrame, DataFrame]:
    """(hub after all sources, links of every source's rows: source, place, hub_key, how).

    Sources come one after another, and each one sees what those before it added: ids, and people whom nobody knew, who are
    hub rows from then on. A field is taken from the first row that has it; ``match_sources`` says how each source found a
    person, by its last row. A source's rows that find nobody and share name and position are one person.

    ``hub``: see :func:`new_hub`. Each source's hub is written, so that later steps do not repeat it."""
    links = []
    ids = list(dict.fromkeys(["gsis_id", *(i for s in sources for i in s.ids)]))
    hub = hub.withColumns({i: F.lit(None).cast("string") for i in ids if i not in hub.columns})
    fields = [*PERSON, *ids]
    for k, source in enumerate(sources, 1):
        got = settle(find_in_hub(source, hub), "found")
        links.append(got.select(F.lit(source.name).alias("source"), "place", "hub_key", "how"))
        has = [c for c in fields if c in got.columns]
        text = lambda c: blank_to_null(F.col(c).cast("string"))
        first = [F.min_by(text(c), F.when(text(c).isNotNull(), F.col("place"))).alias(f"_{c}") for c in has]
        brought = got.groupBy(F.col("hub_key").alias("_key")).agg(F.min("place").alias("_place"), F.max_by("how", "place").alias("_how"), *first)
        both = hub.join(brought, F.col("hub_key") == F.col("_key"), "full")
        seq = F.coalesce("seq", F.struct(F.lit(k).alias("source"), F.col("_place").cast("long").alias("place")))
        seen = F.when(F.col("_how").isNotNull(), F.create_map(F.lit(source.name), F.col("_how")))
        empty = F.create_map().cast("map<string,string>")
        hub = both.select(
            F.coalesce("hub_key", "_key").alias("hub_key"), seq.alias("seq"), *[F.coalesce(c, f"_{c}").alias(c) if c in has else F.col(c) for c in fields],
            F.map_concat(F.coalesce("match_sources", empty), F.coalesce(seen, empty)).alias("match_sources"),
        )
        hub = settle(hub, "hub")
    return hub, reduce(lambda x, y: x.unionByName(y), links)


def first_value(rows: DataFrame, key: str, column: str, priority: str) -> DataFrame:
    """The value that is not blank of the source that comes first."""
    v = rows.withColumn("_v", blank_to_null(F.col(column))).filter(F.col("_v").isNotNull())
    return v.groupBy(key).agg(F.min_by("_v", priority).alias(column))


def override(rows: DataFrame, corrections: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Corrections that are not null win over everything."""
    c = corrections.select(F.col(key).alias("_k"), *[F.col(x).alias(f"_{x}") for x in columns])
    return rows.join(c, F.col(key) == F.col("_k"), "left").withColumns({x: F.coalesce(f"_{x}", x) for x in columns}).drop("_k", *[f"_{x}" for x in columns])


def unmatched(links: DataFrame) -> DataFrame:
    """Rows that found no player, by source and then by draft position, unknown ones last."""
    return links.filter(F.col("player_id").isNull()).orderBy("source", F.asc_nulls_last("adp"), "source_id")


def _kind() -> tuple[Column, Column]:
    """(kind and value) of the key by which a stored person is known: league id, a defence's team, or name and position."""
    gsis, defence = blank_to_null(F.col("gsis_id")), F.col("position") == "DEF"
    kind = F.when(gsis.isNotNull(), "id").when(defence, "def").otherwise("name")
    return kind, F.when(gsis.isNotNull(), gsis).when(defence, F.coalesce("team", F.lit(""))).otherwise(F.concat_ws("|", "name_norm", "position"))


def upsert(stored: DataFrame, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The stored players (player_id and ``columns``) after a hub's rows: values that are not empty overwrite, nothing is
    deleted, and player_id stays for ever.

    Rows meet by one key of kind and value: the league id where a row has one, else a defence's team, else name and position
    of players without an id. A row whose id is not stored yet takes over the player of its name and position who has none
    and whom no other row is, so a player who gets an id keeps his player_id. Of rows with one key the first by hub_key
    counts, of stored ones the least player_id; rows without name or position are left out. New players get the next
    player_ids, numbered by range partitions. A second run with the same rows changes nothing."""
    kind, value = _kind()
    key = F.struct(kind.alias("kind"), value.alias("value"))
    r = rows.filter(blank_to_null(F.col("name")).isNotNull() & blank_to_null(F.col("position")).isNotNull()).withColumn("_key", key)
    r = r.groupBy("_key").agg(F.min_by(F.struct(*[blank_to_null(F.col(c).cast("string")).alias(c) for c in columns]), "hub_key").alias("_row"))
    h = stored.withColumn("_key", key).groupBy("_key").agg(F.min("player_id").alias("_id"))
    met = r.join(h, "_key", "left")
    by_name = F.struct(F.lit("name").alias("kind"), F.concat_ws("|", "_row.name_norm", "_row.position").alias("value"))
    waiting = met.filter("_id is null and _key.kind = 'id'").groupBy(by_name.alias("_name")).agg(F.min("_key").alias("_taker"))
    free = h.filter("_key.kind = 'name'").join(r.select("_key"), "_key", "left_anti").select(F.col("_key").alias("_name"), F.col("_id").alias("_taken"))
    takers = waiting.join(free, "_name").select(F.col("_taker").alias("_key"), "_taken")
    met = met.join(takers, "_key", "left").withColumn("_id", F.coalesce("_id", "_taken")).select("_key", "_id", "_row")
    kept = stored.join(met.filter("_id is not null").select("_id", "_row"), F.col("player_id") == F.col("_id"), "left")
    kept = kept.select("player_id", *[F.coalesce(F.col(f"_row.{c}"), F.col(c).cast("string")).alias(c) for c in columns])
    last = stored.agg(F.coalesce(F.max("player_id"), F.lit(0)).alias("_last"))
    new = numbered(met.filter("_id is null").select(F.to_json("_key").alias("_k"), "_row"), "_k")
    new = new.join(F.broadcast(last)).select((F.col("_last") + F.col("_no")).alias("player_id"), *[F.col(f"_row.{c}").alias(c) for c in columns])
    return kept.unionByName(new)


def numbered(rows: DataFrame, key: str, buckets: int = 4096) -> DataFrame:
    """``_no``: 1, 2, ... in the order of a hash of ``key`` and then of ``key``, which is unique.

    Hash ranges are counted, their counts summed up (one row a range), and rows are numbered within their range."""
    h = rows.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)))
    n = h.groupBy("_b").agg(F.count("*").alias("_c"))
    offset = n.select(F.col("_b").alias("_ob"), F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    h = h.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(key)))
    return h.join(F.broadcast(offset), F.col("_b") == F.col("_ob")).withColumn("_no", F.col("_o") + F.col("_r")).drop("_b", "_ob", "_o", "_r")


#: Most players in a list, and the parts that a team's rows are dealt to.
LISTED, DEALT = 1024, 64


def _listed(players: DataFrame) -> DataFrame:
    """(_t, _players): each team's players in lists of a bounded length; players without a team are in none."""
    known = players.filter("team is not null").select(F.col("team").alias("_t"), "player_id", F.pmod(F.xxhash64("player_id"), F.lit(16)).alias("_h"))
    nth = F.row_number().over(Window.partitionBy("_t", "_h").orderBy("player_id"))
    lists = known.withColumn("_n", F.floor((nth - 1) / LISTED)).groupBy("_t", "_h", "_n")
    return lists.agg(F.collect_list(F.struct("player_id"))["player_id"].alias("_players")).select("_t", "_players")  # a null stays


def _every_pair(rows: DataFrame, players: DataFrame) -> DataFrame:
    """Each row with each of its team's players, as ``player_id``.

    A team's rows and players are multiplied, and the pairs are the result, so making them is the work. Rows are dealt to
    parts of a team, and lists of players are copied to each part; how many tasks make pairs depends neither on the number
    of teams nor on the few bytes that are shuffled."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = _listed(players).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    part = F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind]), F.lit(DEALT)).cast("int")
    # one key of part and team, so that both sides keep their partitions in the join; list by list, so that files repeat a few players at a time
    lists = lists.select(F.concat_ws("|", F.col("_p").cast("string"), "_t").alias("_k"), "_players").repartition(tasks, "_k")
    dealt = rows.filter("team is not null").withColumn("_d", F.concat_ws("|", part.cast("string"), "team")).repartition(tasks, "_d")
    both = lists.join(dealt, F.col("_k") == F.col("_d"))
    return both.select(*rows.columns, F.explode("_players").alias("player_id"))


def match_market(names: DataFrame, hub: DataFrame) -> DataFrame:
    """Market rows to players: by name and position; where several players share them, only if the team agrees; else by
    last name, position and team; defences by team alone, each with all that its team has."""
    defence, team = (d.filter("position = 'DEF'") for d in (names, hub))
    found = [_every_pair(defence, team).withColumn("matched_by", F.lit("team"))]
    rest, people = names.filter("position <> 'DEF'"), hub.filter("position <> 'DEF'")
    got, left = _step(rest, people, ["name_norm", "position"], "name_pos")
    found.append(got)
    got, left = _step(left, people, ["name_norm", "position", "team"], "name_pos_team")
    found.append(got)
    last = lambda d: d.withColumn("last_name", F.element_at(F.split("name_norm", " "), -1))
    got, _ = _step(last(left), last(people), ["last_name", "position", "team"], "last_name_team")
    found.append(got.drop("last_name"))
    return reduce(lambda a, b: a.unionByName(b), found)


def id_coverage(hub: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Players, and how many have each id; a blank one is none."""
    return hub.agg(F.count("*").alias("players"), *[F.count(blank_to_null(F.col(i).cast("string"))).alias(i) for i in ids])


#: How two kinds of player ids are written.
ID_STYLES = {"gsis_style": r"^\d{2}-\d{7}$", "esb_style": r"^[A-Z]{3}\d{6}$"}


def id_styles(players: DataFrame, column: str, keys: Sequence[str] = (), styles: Mapping[str, str] = ID_STYLES) -> DataFrame:
    """Per ``keys``: rows, ids that are there, and how many are written in each style."""
    return players.groupBy(*keys).agg(F.count("*").alias("rows"), F.count(column).alias("non_null"), *[F.count_if(F.col(column).rlike(p)).alias(k) for k, p in styles.items()])


def unknown_teams(players: DataFrame, known: Sequence[str] = (*CLUBS, *NO_CLUB)) -> DataFrame:
    """Team codes that are not known, and how many players have them. No row is the good case."""
    return players.filter(~F.col("team").isin(*known)).groupBy("team").agg(F.count("*").alias("players"))


def resolved_share(ranks: DataFrame, depth: int) -> DataFrame:
    """Of each source's first ``depth`` rows, the share that has a player."""
    return ranks.filter(F.col("rank") <= depth).groupBy("source").agg(F.count("*").alias("n"), F.avg(F.col("player_id").isNotNull().cast("double")).alias("resolved"))


def listing(hub: DataFrame, ranks: DataFrame, part: str | None = None, position: str | None = None, limit: int = 50) -> DataFrame:
    """Players by rank, unknown ones last, filtered by a part of the name and by position."""
    out = hub
    if part:
        out = out.filter(F.lower("name").contains(part.lower()))
    if position:
        out = out.filter(F.col("position") == position)
    return out.join(ranks, "player_id", "left").orderBy(F.asc_nulls_last("rank"), "player_id").limit(limit)
