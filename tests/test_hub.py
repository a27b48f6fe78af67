"""A hub that grows from source to source, and stored players that keep their ids."""

from fieldmark.operators import identity
from fieldmark.operators.identity import Source, grow_hub, new_hub, upsert

PERSON = "name string, name_norm string, position string, team string"
COLUMNS = ["gsis_id", "name", "name_norm", "position", "team", "y_id"]


def _rows(spark, rows, ids):
    return spark.createDataFrame(rows, f"place long, {', '.join(f'{i} string' for i in ids)}, {PERSON}")


def who(name, position="WR", team="KC"):
    return (name, name.lower(), position, team)


def _hub(spark):
    roster = [(1, "g1", None, *who("Ann")), (2, "g2", "y2", *who("Bob", "RB")), (3, "g3", None, *who("Bob", "RB", "SF")), (4, None, None, *who("Chiefs", "DEF")), (5, "g1", "y1", *who("Ann again"))]
    return new_hub(_rows(spark, roster, ["gsis_id", "y_id"]), ["y_id"], "roster")


def test_player_of_later_sources_gets_one_row(spark):
    one = _rows(spark, [(1, "s1", *who("New Man")), (2, None, *who("new man", team="SF")), (3, None, *who("Ann")), (4, "s4", *who("Bob", "RB", "SF")), (5, "s5", *who("Bob", "RB", "LA")), (6, None, *who("x", "DEF"))], ["s_id"])
    two = _rows(spark, [(1, "s1", "y9", *who("Renamed")), (2, None, "y2", *who("Robert", "RB")), (3, None, None, None, None, None, None)], ["s_id", "y_id"])
    three = _rows(spark, [(1, "y9", *who("Nobody's name")), (2, "y7", *who("Lost")), (3, "y8", *who("Also lost"))], ["y_id"])
    known = spark.createDataFrame([("y7", "g7", "Real Name", "real name"), ("y8", None, "Other Name", "other name")], "y_id string, gsis_id string, name string, name_norm string")
    hub, links = grow_hub(_hub(spark), [Source("one", one, ["s_id"]), Source("two", two, ["s_id", "y_id"]), Source("three", three, ["y_id"], "y_id", known)])
    assert sorted((r.source, r.place, r.hub_key, r.how) for r in links.collect()) == [
        ("one", 1, "name:new man|WR", "new"), ("one", 2, "name:new man|WR", "new"), ("one", 3, "g1", "name+team+pos"), ("one", 4, "g3", "name+team+pos"), ("one", 5, "name:bob|RB", "new"), ("one", 6, "DEF:KC", "def:team"),
        ("three", 1, "name:new man|WR", "id:y_id"), ("three", 2, "g7", "registry:y_id"), ("three", 3, "name:other name|WR", "registry:y_id"), ("two", 1, "name:new man|WR", "id:s_id"), ("two", 2, "g2", "id:y_id"),
    ]
    rows = {r.hub_key: r for r in hub.collect()}
    assert sorted(rows) == ["DEF:KC", "g1", "g2", "g3", "g7", "name:bob|RB", "name:new man|WR", "name:other name|WR"]
    new = rows["name:new man|WR"]
    assert (new["name"], new.team, new.s_id, new.y_id, new.match_sources) == ("New Man", "KC", "s1", "y9", {"one": "new", "two": "id:s_id", "three": "id:y_id"})
    assert (rows["g1"].y_id, rows["g1"]["name"], rows["g7"]["name"], rows["g7"].gsis_id) == ("y1", "Ann", "Real Name", "g7")


def test_first_hub_row_wins(spark):
    """Several hub rows with one id, or one name, team and position: the first one is meant; a name alone must be alone."""
    hub = new_hub(_rows(spark, [(7, "g7", "y", *who("Same")), (3, "g3", "y", *who("Same")), (4, "g4", None, *who("Same", team="SF"))], ["gsis_id", "y_id"]), ["y_id"], "r")
    rows = _rows(spark, [(1, "y", *who("Other")), (2, None, *who("Same")), (3, None, *who("Same", team=None))], ["y_id"])
    got = {r.place: (r.hub_key, r.how) for r in identity.find_in_hub(Source("s", rows, ["y_id"]), hub).collect()}
    assert got == {1: ("g3", "id:y_id"), 2: ("g3", "name+team+pos"), 3: ("name:same|WR", "new")}


def test_empty_sources(spark):
    none = _rows(spark, [], ["y_id"])
    hub, links = grow_hub(_hub(spark), [Source("one", none, ["y_id"])])
    assert hub.count() == 4 and links.count() == 0
    assert new_hub(_rows(spark, [], ["gsis_id", "y_id"]), ["y_id"], "r").count() == 0


def test_upsert_three_kinds(spark):
    stored = spark.createDataFrame(
        [(5, "g1", *who("Ann"), None), (9, None, *who("Chiefs", "DEF"), "yd"), (7, None, *who("Got Id"), "y7"), (8, None, *who("Still None"), "y8"), (11, "g11", *who("Gone"), None)],
        f"player_id long, gsis_id string, {PERSON}, y_id string",
    )
    rows = spark.createDataFrame(
        [("g1", "g1", *who("Ann", team="SF"), " "), ("DEF:KC", None, *who("Kansas", "DEF"), None), ("g7", "g7", *who("Got Id"), None), ("name:still none|WR", None, *who("Still None"), "new"),
         ("name:fresh|WR", None, *who("Fresh"), None), ("g20", "g20", *who("Still None"), None), ("DEF:SF", None, *who("Niners", "DEF", "SF"), None), ("x", None, None, None, None, None, None)],
        f"hub_key string, gsis_id string, {PERSON}, y_id string",
    )
    out = upsert(stored, rows, COLUMNS)
    got = {r.player_id: (r.gsis_id, r["name"], r.team, r.y_id) for r in out.collect()}
    assert {k: got[k] for k in (5, 7, 8, 9, 11)} == {
        5: ("g1", "Ann", "SF", None), 7: ("g7", "Got Id", "KC", "y7"), 8: (None, "Still None", "KC", "new"), 9: (None, "Kansas", "KC", "yd"), 11: ("g11", "Gone", "KC", None),
    }
    assert sorted(k for k in got if k > 11) == [12, 13, 14]
    assert {got[k][:2] for k in (12, 13, 14)} == {(None, "Fresh"), ("g20", "Still None"), (None, "Niners")}
    again = {r.player_id: (r.gsis_id, r["name"], r.team, r.y_id) for r in upsert(out, rows, COLUMNS).collect()}
    assert again == got
