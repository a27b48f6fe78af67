"""Support and risk signals, flags, and the reasons behind a rank, as arrays built in one projection."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.columns import flag
from fieldmark.functions.ranking import ordinals

SKILL = ("RB", "WR", "TE")
MOST_REASONS = 6


def established(adp: Column, prior_rank: Column, position: Column, teams: int, slots: dict[str, int]) -> Column:
    """Drafted early, or among the starters of his position last year."""
    places = F.create_map(*[x for p, n in slots.items() for x in (F.lit(p), F.lit(n))])
    return flag(adp <= teams * 5) | flag(prior_rank <= teams * places[position])


def chosen(*pairs: tuple[str, Column]) -> Column:
    """Names whose condition holds, in order; null is no."""
    return F.array_compact(F.array(*[F.when(flag(c), F.lit(name)) for name, c in pairs]))


#: The names of signals as results have them.
GAINS = {
    "target_share": "opportunity_gain", "touchdowns": "negative_td_luck", "depth": "depth_chart_rise", "points": "ppg_trend_up", "share": "elite_opportunity", "youth": "young_with_role",
    "luck": "underperformed_expected_points", "vacated": "inherits_vacated_opportunity", "model": "our_model_sees_more_than_the_vendor", "context": "team_context_tailwind",
    "capital": "high_draft_capital_with_a_role", "line": "team_context:offensive line upgrade",
}
RISKS = {
    "touchdowns": "positive_td_luck", "injuries": "injury_prone", "structural": "structural_injury_return", "age": "age_cliff", "experts": "expert_disagreement", "absence": "announced_absence",
    "team": "team_context:", "caller": "new play-caller", "passer": "unsettled QB room", "line": "offensive line downgrade",
}


def support() -> Column:
    """What speaks for a player beyond the market's view; the team's context counts once."""
    c, name = F.col, GAINS
    skill_youth = c("position").isin(*SKILL) & (c("age") <= 24) & (F.coalesce("last_ppg", F.lit(0)) > 0)
    return chosen(
        (name["target_share"], c("yoy_target_share") >= 0.03), (name["touchdowns"], c("td_diff") <= -3), (name["depth"], c("depth_change") < 0), (name["points"], c("yoy_ppg") >= 2),
        (name["share"], flag(c("target_share") >= 0.25) | flag(c("carry_share") >= 0.55)), (name["youth"], skill_youth), (name["luck"], c("ppg_diff") <= -1), (name["vacated"], c("vacated_gain") >= 0.02),
        (name["model"], c("inhouse_edge") >= 1), (name["context"], c("context") >= 1.02), (name["capital"], c("is_rookie") & (c("draft_round") <= 2) & (c("depth_rank") <= 2)), (name["line"], c("line_delta") >= 1),
    )


def risk() -> Column:
    """What speaks against a player; new caller, unsettled passer and a worse line are one signal of the team."""
    c, name = F.col, RISKS
    team = chosen((name["caller"], c("new_caller")), (name["passer"], c("qb_unsettled")), (name["line"], c("line_delta") <= -1))
    own = chosen(
        (name["touchdowns"], c("td_diff") >= 3), (name["injuries"], c("injury_prone")), (name["structural"], c("structural_return")), (name["age"], c("past_cliff")),
        (name["experts"], c("disagreement") >= c("disagreement_cut")), (name["absence"], c("known_missed") >= 2),
    )
    return F.concat(own, F.when(F.size(team) > 0, F.array(F.concat(F.lit(name["team"]), F.array_join(team, ", ")))).otherwise(F.array().cast("array<string>")))


def flags(support_: Column, risk_: Column) -> Column:
    """What a player is marked with; then sleeper or value where the room is late and signals support it, bust or reach
    where it is early and risks are there."""
    c = F.col
    open_ = flag(c("adp") <= 220) & ~c("position").isin("K", "DEF")
    up = open_ & flag((c("gap_z") >= 1) & (c("gap") >= 6)) & (F.size(support_) >= 2)
    down = open_ & flag((c("gap_z") <= -1) & (c("gap") <= -6)) & (F.size(risk_) >= 2)
    reach = flag(c("pos_gap") > -5)
    marks = [("injury_prone", c("injury_prone")), ("structural_injury_return", c("structural_return")), ("rookie", c("is_rookie")), ("new_play_caller", c("new_caller")), ("qb_uncertain_team", c("qb_unsettled"))]
    return chosen(*marks, ("value", up & flag(c("established"))), ("sleeper", up & ~flag(c("established"))), ("positional_reach", down & reach), ("bust", down & ~reach))


@dataclass(frozen=True)
class Rule:
    """One kind of reason: when it is given, what it says, what kind it is, whether it speaks for a player (1), against him
    (-1) or neither (0), the years it is about, and the numbers and texts it rests on."""

    rule_id: str
    priority: int
    kind: str
    when: Column
    polarity: Column
    text: Column
    numbers: Mapping[str, Column] = field(default_factory=dict)
    labels: Mapping[str, Column] = field(default_factory=dict)
    years: str = "now"

    def column(self) -> Column:
        """A struct; null where the rule is not met."""
        pairs = lambda m, kind: F.map_filter(F.create_map(*[x for k, v in m.items() for x in (F.lit(k), v.cast(kind))]).cast(f"map<string,{kind}>"), lambda _, v: v.isNotNull())
        return F.when(flag(self.when), F.struct(
            F.lit(self.priority).alias("priority"), F.lit(self.rule_id).alias("rule_id"), self.text.alias("text"), F.lit(self.kind).alias("kind"), self.polarity.cast("int").alias("polarity"),
            F.lit(self.years).alias("years"), pairs(self.numbers, "double").alias("numbers"), pairs(self.labels, "string").alias("labels"),
        ))


def rules() -> list[Rule]:
    """Every rule, over the columns that a ranked player has: his projection (ppg, vorp, e_games, pos_rank), the market's view
    (room_adp, our_pick, gap, gap_z, ecr_sd, disagreement, vendor_ppg, inhouse_ppg), the last two seasons (last_ppg, prev_ppg,
    target_share, prev_target_share, carry_share, td_diff, ppg_diff), durability, depth chart, team context and person.

    Ids, priorities, kinds, polarities and triggers are fixed values of the rules; the wording is our own."""
    c, f = F.col, F.format_string
    none, zero_, up, down = F.lit(""), F.lit(0), F.lit(1), F.lit(-1)
    side = lambda x: F.when(x > 0, 1).otherwise(-1)
    part = lambda form, *x: F.when(reduce(lambda a, b: a & b, [y.isNotNull() for y in x]), f(form, *x)).otherwise(none)
    whole = lambda x: x.cast("long")
    runs = c("position").eqNullSafe(F.lit("RB")) & flag(c("carry_share") > 0)
    target_change, ppg_change, model_gap, market = c("target_share") - c("prev_target_share"), c("last_ppg") - c("prev_ppg"), c("inhouse_ppg") - c("vendor_ppg"), c("room_adp") - c("our_pick")
    missed_now = F.coalesce(c("known_missed"), zero_)
    return [
        Rule("projection", 5, "value", c("ppg").isNotNull(), zero_, F.concat(f("Projected for %.1f points a game", c("ppg")), part(", %s%d", c("position"), whole(c("pos_rank"))), part(", %.0f over replacement", c("vorp")), part(", in %.1f games", c("e_games"))),
             {"ppg": c("ppg"), "vorp": c("vorp"), "e_games": c("e_games")}),
        Rule("rookie_draft_capital", 8, "rookie", c("is_rookie"), F.when(c("draft_round").isNull(), -1).when(c("draft_round") == 1, 1).otherwise(0),
             F.when(c("draft_round").isNull(), "Rookie whom no team drafted").otherwise(F.concat(f("Rookie of round %d", whole(c("draft_round"))), part(", pick %d", whole(c("draft_pick"))), part(", by %s", c("draft_team")))),
             {"round": c("draft_round"), "pick": F.when(c("draft_round").isNotNull(), c("draft_pick"))}, {"team": F.when(c("draft_round").isNotNull(), c("draft_team"))}),
        Rule("target_share_trend", 10, "opportunity", (F.abs(target_change) >= 0.03) & c("position").isin(*SKILL), side(target_change), f("Share of targets went from %.0f%% to %.0f%%", c("prev_target_share") * 100, c("target_share") * 100),
             {"prev": c("prev_target_share"), "cur": c("target_share"), "delta": F.round(target_change, 3)}, years="last two"),
        Rule("ppg_trend", 12, "opportunity", (c("prev_ppg") != 0) & (F.abs(ppg_change) >= 1.5), side(ppg_change), f("%.1f points a game after %.1f the year before", c("last_ppg"), c("prev_ppg")), {"prev": c("prev_ppg"), "cur": c("last_ppg")}, years="last two"),
        Rule("carries_share", 14, "opportunity", (c("position") == "RB") & (c("carry_share") >= 0.55), up, f("Carried the load: %.0f%% of the team's runs", c("carry_share") * 100), {"carry_share": c("carry_share")}, years="last"),
        Rule("depth_chart", 16, "opportunity", c("depth_rank").isNotNull(), F.when(c("depth_rank") == 1, 1).when(c("depth_rank") == 2, 0).otherwise(-1),
             F.concat(f("Place %d of the depth chart at %s", whole(c("depth_rank")), c("position")), part(" (%s)", c("depth_as_of").cast("string")), F.when(flag(c("depth_change") != 0), f(", %s by %d in a month", F.when(c("depth_change") < 0, "up").otherwise("down"), whole(F.abs("depth_change")))).otherwise(none)),
             {"depth_rank": c("depth_rank"), "change_30d": c("depth_change")}),
        Rule("usage_level", 18, "opportunity", runs | (c("target_share") > 0), F.when(runs, (c("carry_share") >= 0.5).cast("int")).otherwise((c("target_share") >= 0.20).cast("int")),
             F.when(runs, f("Took %.0f%% of the team's runs", c("carry_share") * 100)).otherwise(f("Drew %.0f%% of the team's targets", c("target_share") * 100)),
             {"carry_share": F.when(runs, c("carry_share")), "target_share": F.when(~runs, c("target_share"))}, years="last"),
        Rule("td_regression", 20, "regression", F.abs("td_diff") >= 3, -side(c("td_diff")), f("%.1f touchdowns %s what his chances gave", F.abs("td_diff"), F.when(c("td_diff") > 0, "above").otherwise("below")), {"td_diff": c("td_diff")}, years="last"),
        Rule("ppg_luck", 22, "regression", F.abs("ppg_diff") >= 1, -side(c("ppg_diff")), f("%.1f points a game %s expectation", F.abs("ppg_diff"), F.when(c("ppg_diff") > 0, "above").otherwise("below")), {"ppg_diff": c("ppg_diff")}, years="last"),
        Rule("current_injury", 28, "durability", (c("status") != "") & ~c("status").isin("Active", "ACT"), down,
             F.concat(F.lit("On the list as "), c("status"), part(" (%s)", F.nullif(c("body_part"), none)), F.when(missed_now > 0, f(", to miss %d weeks", whole(missed_now))).otherwise(none)), {"known_missed_weeks": missed_now}, {"status": c("status")}),
        Rule("games_missed", 30, "durability", (c("missed_3y") >= 3) & (c("eligible_3y") > 0), down,
             F.concat(f("Out for %d of %d games in three years", whole(c("missed_3y")), whole(c("eligible_3y"))), F.when(flag(F.size("causes") > 0), F.concat(F.lit(": "), F.array_join(F.slice("causes", 1, 3), ", "))).otherwise(none), part("; %.1f games expected", c("e_games"))),
             {"missed": c("missed_3y"), "eligible": c("eligible_3y"), "e_games": c("e_games")}, years="last three"),
        Rule("new_play_caller", 40, "context", c("new_caller"), zero_, F.concat(F.lit("Plays are called by somebody new: "), F.coalesce(F.nullif(c("play_caller"), none), F.lit("not known yet"))), {}, {"play_caller": F.coalesce(F.nullif(c("play_caller"), none), F.lit("new play-caller"))}),
        Rule("qb_situation", 41, "context", (c("qb_status") != "") & (c("qb_status") != "settled"), down, F.concat(F.lit("Passer not settled: "), c("qb_status"), F.lit(", first now "), F.coalesce(c("qb1"), F.lit("TBD"))), {}, {"qb_status": c("qb_status"), "projected_qb1": F.coalesce(F.nullif(c("qb1"), none), F.lit("TBD"))}),
        Rule("ol_delta", 42, "context", c("line_delta") != 0, side(c("line_delta")), F.concat(f("Offensive line %s by %d", F.when(c("line_delta") > 0, "better").otherwise("worse"), whole(F.abs("line_delta"))), part(": %s", F.nullif(c("line_note"), none))), {"ol_delta": c("line_delta")}),
        Rule("new_head_coach", 43, "context", c("new_coach"), zero_, F.concat(F.lit("Head coach is new: "), F.coalesce(c("coach"), F.lit("not known"))), {}, {"hc": c("coach")}),
        Rule("adp_gap", 50, "market", (F.abs("gap") >= 6) & (F.abs("gap_z") >= 1), side(c("gap")), f("The room takes him %d picks %s than we would (%.1f deviations)", whole(F.abs("gap")), F.when(c("gap") > 0, "later").otherwise("earlier"), c("gap_z")), {"gap": c("gap"), "gap_z": c("gap_z")}),
        Rule("expert_disagreement", 52, "market", c("disagreement") >= 1, down, F.concat(F.lit("Experts are further apart than at other ranks"), part(" (deviation %.1f)", c("ecr_sd"))), {"ecr_std": c("ecr_sd"), "residual": c("disagreement")}),
        Rule("projection_sources", 54, "value", F.abs(model_gap) >= 1, side(model_gap), f("Own model at %.1f points a game, the vendor at %.1f", c("inhouse_ppg"), c("vendor_ppg")), {"vendor": c("vendor_ppg"), "inhouse": c("inhouse_ppg"), "blend": c("ppg")}),
        Rule("market_position", 55, "market", c("room_adp").isNotNull() & c("our_pick").isNotNull(), zero_,
             F.concat(f("Gone around pick %d, ours at %d: ", whole(c("room_adp")), whole(c("our_pick"))), F.when(F.abs(market) < 6, "no real difference").otherwise(f("%d picks %s", whole(F.abs(market)), F.when(market > 0, "later").otherwise("earlier")))),
             {"room_adp": c("room_adp"), "our_pick": c("our_pick")}),
        Rule("age", 60, "bio", c("age").isNotNull() & (c("age_factor") != 1), F.when(c("age_factor") < 1, -1).otherwise(1), f("Age %.0f: a factor of %.2f at %s", c("age"), c("age_factor"), c("position")), {"age": c("age"), "factor": c("age_factor")}),
        Rule("experience", 62, "bio", ~flag(c("is_rookie")) & c("years_exp").isNotNull(), (c("years_exp") == 1).cast("int"), F.concat(F.when(c("years_exp") == 1, "Second season").otherwise(f("Season number %d", whole(c("years_exp") + 1))), part(", age %.0f", c("age"))), {"years_exp": c("years_exp"), "age": c("age")}),
        Rule("contract", 70, "bio", flag(c("contract_year")) | flag(c("just_paid")), zero_, F.when(flag(c("contract_year")), "Last year of his contract").otherwise("New contract at the top of his position")),
    ]


def reasons() -> Column:
    """At most six reasons by priority and rule; the plain usage line gives way where the workload one is there."""
    every = F.array_compact(F.array(*[r.column() for r in rules()]))
    heavy = F.exists(every, lambda r: r["rule_id"] == "carries_share")
    kept = F.filter(every, lambda r: ~((r["rule_id"] == "usage_level") & heavy))
    # Maps have no order, so the array is sorted by priority and rule alone.
    before = lambda a, b: (a["priority"] < b["priority"]) | ((a["priority"] == b["priority"]) & (a["rule_id"] < b["rule_id"]))
    return F.slice(F.array_sort(kept, lambda a, b: F.when(before(a, b), -1).when(before(b, a), 1).otherwise(0)), 1, MOST_REASONS)


def reason_rows(ranked: DataFrame) -> DataFrame:
    """One row a reason: league_id, player_id, place, rule_id, text, kind, polarity, years, numbers, labels."""
    r = ranked.select("league_id", "player_id", F.posexplode(reasons()).alias("place", "r"))
    return r.select("league_id", "player_id", "place", "r.rule_id", "r.text", "r.kind", "r.polarity", "r.years", "r.numbers", "r.labels")


def prior_ranks(seasons: DataFrame, season: int, least_games: int = 8) -> DataFrame:
    """Place by points a game among all of a position, equal ones by id, kept only for those with enough games."""
    r = ordinals(seasons.filter(F.col("season") == season), ["position"], [F.desc("ppg"), F.asc("player_id")], "prior_rank")
    return r.filter(F.col("games") >= least_games).select("player_id", "prior_rank")
