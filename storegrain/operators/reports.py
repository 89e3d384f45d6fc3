"""Report, statistics and prompt texts as columns; wording is this library's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from storegrain.functions.columns import all_of, first_present, fixed_text
from storegrain.functions.risk import survival_band
from storegrain.operators.joins import attach
from storegrain.operators.ranking import top_k
from storegrain.operators.stats import CATEGORY, DISTRICT, keyword_match

TURNS = 5


def count_text(value) -> Column:
    return F.format_number(F.col(value) if isinstance(value, str) else value, 0)


def percent_text(value) -> Column:
    """One decimal of the number as it is stored, exact halves to the even digit."""
    return F.concat(fixed_text(F.col(value) if isinstance(value, str) else value, 1), F.lit("%"))


def share_text(value) -> Column:
    """A share of 1 as a percentage; halves of its shortest decimal form go up, except .25."""
    value = ((F.col(value) if isinstance(value, str) else value) * 100).cast("double")
    even = F.when(value - F.floor(value) == 0.25, value - 0.01).otherwise(value)
    return F.format_string("%.1f%%", even)


def stats_text(stats: DataFrame, tops: DataFrame | None = None) -> DataFrame:
    """Text block per scope row of ``stats_cube``: size, rates, status counts and, from ``scope_tops``, the top lists."""
    lists = []
    if tops is not None:
        scope_key = F.to_json(F.struct("level", "category", "district")).alias("_scope")
        names = {"top_categories": "top categories", "top_sub_categories": "top sub-categories", "top_districts": "top districts"}
        stats = attach(stats.withColumn("_scope", scope_key), tops.select(scope_key, *names), "_scope")
        lists = [F.concat(F.lit(f"{title}: "), F.col(name)) for name, title in names.items()]
    scope = F.concat_ws(" / ", F.coalesce("category", F.lit("all categories")), F.coalesce("district", F.lit("all districts")))
    head = F.concat(scope, F.lit(": "), count_text("total"), F.lit(" stores"))
    rates = F.when(
        F.col("active") + F.col("closed") > 0,
        F.concat(F.lit("trading "), count_text("active"), F.lit(" ("), percent_text("survival_rate"), F.lit("), closed "),
                 count_text("closed"), F.lit(" ("), percent_text("closure_rate"), F.lit("), suspended "), count_text("suspended"),
                 F.lit(", unknown "), count_text(F.col("total") - F.col("active") - F.col("closed") - F.col("suspended"))))
    return stats.select("level", "category", "district", F.concat_ws("\n", head, rates, *lists).alias("stats_text"))


def last_turns(turns: DataFrame, k: int = TURNS) -> DataFrame:
    """The last ``k`` turns of every conversation as one text, oldest first."""
    tail = top_k(turns, ["conv_id"], [F.desc("turn")], k)
    speaker = F.when(F.col("role") == "user", "user").otherwise("adviser")
    line = F.concat(speaker, F.lit(": "), F.coalesce("text", F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return tail.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("history"))


def request_context(requests: DataFrame, cube: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Requests with the statistics of their category, their district and both, and search results if given.

    ``cube`` is the output of ``stats_cube``; it is read three times, so hand over a
    staged one. A category may be the same for most requests; adaptive execution splits it.
    """
    def scope(level: int, keys: list[str], tag: str) -> DataFrame:
        rows = cube.filter(F.col("level") == level).filter(all_of([F.col(k).isNotNull() for k in keys]))
        key = keys[0] if len(keys) == 1 else "_pair"
        name = F.col(key) if len(keys) == 1 else F.to_json(F.struct(*keys)).alias("_pair")
        return rows.select(name, F.col("total").alias(f"{tag}_total"), F.col("survival_rate").alias(f"{tag}_survival_rate"))

    out = attach(requests, scope(1, ["category"], "category"), "category")
    out = attach(out, scope(2, ["district"], "district"), "district")
    pair = F.when(F.col("category").isNotNull() & F.col("district").isNotNull(), F.to_json(F.struct("category", "district")))
    out = attach(out.withColumn("_pair", pair), scope(0, ["category", "district"], "pair"), "_pair").drop("_pair")
    if found is not None:
        out = attach(out, found, "request_id")
    return out


def matching_counts(df: DataFrame, category: str, district: str) -> DataFrame:
    """Counts behind one request by keyword instead of by equal name."""
    hit_c = keyword_match(first_present(df.columns, CATEGORY), category)
    hit_d = keyword_match(first_present(df.columns, DISTRICT), district)
    return df.agg(
        F.count(F.when(hit_c, 1)).alias("category_total"), F.count(F.when(hit_d, 1)).alias("district_total"),
        F.count(F.when(hit_c & hit_d, 1)).alias("pair_total"))


def rule_report(scored: DataFrame) -> DataFrame:
    """Adds ``report``: a text from scores, factors and recommendations, no language model involved."""
    band = survival_band("survival_1yr")
    advice = F.when(band == "good", "Prospects are good.").when(
        band == "fair", "Prospects are fair; prepare carefully.").otherwise("Prospects are weak; review the risks first.")

    def bullets(name: str, empty: str) -> Column:
        lines = F.array_join(F.transform(F.col(name), lambda x: F.concat(F.lit("- "), x)), "\n")
        return F.when(F.size(name) > 0, lines).otherwise(F.lit(f"- {empty}"))

    text = F.concat_ws(
        "\n",
        F.concat(F.lit("One-year survival "), share_text("survival_1yr"), F.lit(". "), advice),
        F.concat(F.lit("Expected revenue "), count_text("monthly_revenue"), F.lit(" and profit "),
                 count_text("monthly_profit"), F.lit(" per month; break-even after "),
                 F.col("break_even_months").cast("string"), F.lit(" months.")),
        F.concat(F.lit("Risk "), F.col("risk_level"), F.format_string(" (%.2f)", F.col("risk_score"))),
        bullets("risk_factors", "none noted"), F.lit("Advice"), bullets("recommendations", "none"))
    if "stats_text" in scored.columns:
        text = F.concat_ws("\n\n", text, F.col("stats_text"))
    return scored.withColumn("report", text)


TASKS = {
    "report": "Write a full assessment: overall view, survival, finances, competition, risks and next steps.",
    "strategy": "Propose a plan: location, distinction from rivals, first customers, costs and a one-year timeline.",
    "question": "Answer the question below for this applicant and say so where the data do not reach.",
    "competitors": "Assess the competition: intensity, kinds of rivals, saturation, openings and ways to stand out.",
}


def prompt(columns: list[str], kind: str) -> Column:
    """The prompt of one of the four kinds of request, for rows with these columns.

    ``stats_text``, ``context``, ``history`` and ``question`` are used where present.
    """
    def given(name: str, title: str) -> Column:
        if name not in columns:
            return F.lit(None).cast("string")
        return F.concat(F.lit(f"{title}\n"), F.col(name))

    def money(name: str) -> Column:
        return count_text(F.coalesce(F.col(name), F.lit(0)))

    business = F.concat_ws(
        ", ", F.concat(F.lit("Business: "), F.concat_ws(" / ", "business_category", "business_sub_category")),
        F.concat(F.lit("district "), F.col("district")), F.concat(F.lit("investment "), money("initial_investment")))
    forecast = F.concat(
        F.lit("Forecast: one-year survival "), share_text("survival_1yr"), F.lit(", risk "), F.col("risk_level"),
        F.format_string(" (%.2f)", F.col("risk_score")))
    person = F.concat(
        F.lit("Applicant: age "), F.col("age").cast("string"), F.lit(", experience "), F.col("experience_years").cast("string"),
        F.lit(" years, related experience "), F.when(F.col("has_related_experience") == 1, "yes").otherwise("no"))
    finances = F.concat(
        F.lit("Three-year survival "), share_text("survival_3yr"), F.lit(", revenue "), money("monthly_revenue"),
        F.lit(", profit "), money("monthly_profit"), F.lit(", break-even "), F.col("break_even_months").cast("string"),
        F.lit(" months, rent "), money("monthly_rent"), F.lit(", factors: "), F.array_join("risk_factors", "; "))
    rivals = F.concat(F.lit("Competitors nearby: "), F.col("nearby_competitor_count").cast("string"))
    parts = {
        "report": [person, business, forecast, finances],
        "strategy": [business, forecast, person],
        "question": [business, forecast],
        "competitors": [business, rivals, forecast],
    }[kind]
    extra = [given("stats_text", "Statistics"), given("context", "Similar cases")]
    if kind == "question":
        extra += [given("history", "Earlier turns"), given("question", "Question")]
    return F.concat_ws("\n\n", F.lit(TASKS[kind]), *parts, *extra)


def prompt_text(scored: DataFrame, kind: str) -> DataFrame:
    """Adds ``prompt`` for one kind of request."""
    return scored.withColumn("prompt", prompt(scored.columns, kind))


def all_prompts(scored: DataFrame, *keys: str) -> DataFrame:
    """``keys, kind, prompt`` for every kind of request, from one pass over the rows."""
    prompts = F.array(*[F.struct(F.lit(k).alias("kind"), prompt(scored.columns, k).alias("prompt")) for k in TASKS])
    return scored.select(*keys, F.explode(prompts).alias("_p")).select(*keys, "_p.kind", "_p.prompt")
