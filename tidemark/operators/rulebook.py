"""Feedback -> rules: grouping, confidence, matching with the old rulebook, merging, prompts.

A rule context may hold a very large share of all feedback, so lists are never collected
whole: distinct texts are reduced to their first time, cut to the few that a rule keeps
(the cut runs before the shuffle), and only then put into arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import skew
from tidemark.functions import timefn as tf
from tidemark.functions.text import literal_map
from tidemark.session import AS_OF

# Match thresholds, vocabulary of the contexts, wording.
MATCH_THRESHOLDS = {"Paraphrase": 90.0, "Tone Adjust": 85.0, "Expand": 80.0, "Compress": 85.0}
DEFAULT_THRESHOLD = 85.0
FEATURES = ["Paraphrase", "Tone Adjust", "Expand", "Compress"]
TONES = ["formal", "normal", "common", "terminal_word"]
GENRES = ["informative", "narrative", "descriptive", "dialogue"]
SATISFIED, DISSATISFIED = "satisfied", "dissatisfied"
AVOID_WORDING = [("하라", "하지 마라"), ("사용", "사용 금지")]
SHORTER = "원문보다 간결하게 표현"
PREFERENCE = "사용자 선호 패턴 기반"
NO_EXAMPLES = "문장 데이터 기반 규칙 (구체적 가이드라인 추출 필요)"
KEEP_TEXTS, KEEP_EXAMPLES, EXAMPLE_CHARS = 3, 10, 120


def rule_id(feature: Column, tone: Column, genre: Column) -> Column:
    return F.lower(F.concat_ws("_", feature, tone, genre))


def confidence(sat_w: Column, dis_w: Column, sat_n: Column, dis_n: Column) -> Column:
    """Satisfied share, minus 0.2 per dissatisfied weight, plus a bonus for many satisfied answers; in [-1, 1]."""
    total = sat_n + dis_n
    bonus = F.when(sat_n >= 10, 0.1).when(sat_n >= 5, 0.05).when(sat_n >= 3, 0.02).otherwise(0.0)
    raw = sat_n / total - F.lit(0.2) * dis_w + bonus
    return F.when(total == 0, 0.0).otherwise(F.bround(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)), 2))


# --- feedback table -----------------------------------------------------------------------


def pending(feedbacks: DataFrame, k: int = 10) -> DataFrame:
    """The oldest unprocessed feedbacks."""
    return feedbacks.filter(~F.col("processed")).orderBy("id").limit(k)


def mark_processed(feedbacks: DataFrame, done: DataFrame, at: str = AS_OF) -> DataFrame:
    """New snapshot with the given ids marked; others stay as they were."""
    hits = done.select("id").distinct().withColumn("_done", F.lit(True))
    joined = feedbacks.join(hits, "id", "left")
    stamp = F.col("processed_at") if "processed_at" in feedbacks.columns else F.lit(None).cast("timestamp")
    return joined.withColumn("processed_at", F.when(F.col("_done"), tf.as_ts(at)).otherwise(stamp)).withColumn(
        "processed", F.coalesce("_done", "processed")
    ).drop("_done")


def has_feedback(feedbacks: DataFrame) -> DataFrame:
    return feedbacks.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("processed")).alias("pending"))


# --- insights to rules ----------------------------------------------------------------------


def _first_texts(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Array of the first distinct texts per rule, in order of appearance."""
    firsts = rows.filter(F.col(text).isNotNull()).groupBy("rule_id", text).agg(F.min("order").alias("order"))
    kept = skew.rank_rows(firsts, ["rule_id"], [F.asc("order"), F.asc(text)], KEEP_TEXTS, "_r")
    packed = F.array_sort(F.collect_list(F.struct("_r", text)))
    return kept.groupBy("rule_id").agg(F.transform(packed, lambda x: x[text]).alias(out))


def rules_from_insights(insights: DataFrame, now: str = AS_OF) -> DataFrame:
    """One rule per (feature, tone, genre).

    Insights carry id, selected_feature, tone, genre, feedback, recommended_rule, why
    (array), weight, recommendation_score, original, corrected_text and timestamp.
    """
    order = F.struct("timestamp", "id")
    rows = insights.withColumns(
        {
            "rule_id": rule_id(F.col("selected_feature"), F.col("tone"), F.col("genre")),
            "order": order,
            "value": F.coalesce(F.col("weight"), F.col("recommendation_score"), F.lit(1.0)),
        }
    )
    good, bad = F.col("feedback") == SATISFIED, F.col("feedback") == DISSATISFIED
    stats = rows.groupBy("rule_id").agg(
        F.min(F.struct("order", "selected_feature", "tone", "genre")).alias("head"),
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(good).alias("satisfied_count"),
        F.count_if(bad).alias("dissatisfied_count"),
        F.coalesce(F.sum(F.when(good, F.col("value"))), F.lit(0.0)).alias("sat_w"),
        F.coalesce(F.sum(F.when(bad, F.col("value"))), F.lit(0.0)).alias("dis_w"),
    )
    # The longest guideline, the first of equal length.
    texts = rows.filter(good).groupBy("rule_id", "recommended_rule").agg(F.min("order").alias("order"))
    main = texts.groupBy("rule_id").agg(
        F.min(F.struct((-F.length("recommended_rule")).alias("l"), "order", "recommended_rule")).getField("recommended_rule").alias("guideline")
    )
    avoid = F.transform("avoid_raw", _avoid_wording)
    why = rows.select("rule_id", "feedback", "order", F.explode("why").alias("reason"))
    shown = lambda c: F.substring(c, 1, EXAMPLE_CHARS)
    firsts = skew.rank_rows(
        rows.select("rule_id", "order", "feedback", "timestamp", shown("original").alias("original"), shown("corrected_text").alias("corrected")),
        ["rule_id"],
        [F.asc("order")],
        KEEP_EXAMPLES,
        "_r",
    )
    example = F.struct("original", "corrected", "feedback", "timestamp")
    examples = firsts.groupBy("rule_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", example.alias("e")))), lambda x: x["e"]).alias("examples")
    )
    out = (
        stats.join(main, "rule_id", "left")
        .join(_first_texts(rows.filter(bad), "recommended_rule", "avoid_raw"), "rule_id", "left")
        .join(_first_texts(why.filter(good), "reason", "why_good"), "rule_id", "left")
        .join(_first_texts(why.filter(bad), "reason", "why_bad"), "rule_id", "left")
        .join(examples, "rule_id", "left")
    )
    none = F.array().cast("array<string>")
    return out.select(
        "rule_id",
        F.col("head.selected_feature").alias("feature"),
        F.col("head.tone").alias("tone"),
        F.col("head.genre").alias("genre"),
        F.coalesce("guideline", F.lit("")).alias("guideline"),
        F.coalesce(avoid, none).alias("avoid_guidelines"),
        F.coalesce("why_good", none).alias("why_good"),
        F.coalesce("why_bad", none).alias("why_bad"),
        confidence(F.col("sat_w"), F.col("dis_w"), F.col("satisfied_count"), F.col("dissatisfied_count")).alias("confidence"),
        "total_count",
        "satisfied_count",
        "dissatisfied_count",
        F.bround("sat_w", 2).alias("satisfied_weight"),
        F.bround("dis_w", 2).alias("dissatisfied_weight"),
        F.bround(F.col("satisfied_count") / F.col("total_count"), 2).alias("positive_ratio"),
        "examples",
        F.col("head.order.timestamp").alias("created_at"),
        tf.as_ts(now).alias("updated_at"),
    )


def _avoid_wording(text: Column) -> Column:
    for old, new in AVOID_WORDING:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def as_documents(rules: DataFrame) -> DataFrame:
    """Rules in the nested layout of the rulebook document."""
    stats = ["total_count", "satisfied_count", "dissatisfied_count", "satisfied_weight", "dissatisfied_weight", "positive_ratio"]
    return rules.select(
        "rule_id",
        "feature",
        F.struct("tone", "genre", F.lit("any").alias("complexity")).alias("context"),
        "guideline",
        "avoid_guidelines",
        "why_good",
        "why_bad",
        "confidence",
        F.struct(*stats).alias("statistics"),
        "examples",
        "created_at",
        "updated_at",
    )


# --- merging with the old rulebook -------------------------------------------------------------


def common_letters(x: Column, y: Column) -> Column:
    """Length of the longest common subsequence of two short texts, row by row of its table."""
    letters, n = F.split(y, ""), F.length(y)

    def next_row(row: Column, c: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            step = F.get(row, j - 1) + F.lit(1)
            return F.array_append(done, F.when(F.get(letters, j - 1) == c, step).otherwise(F.greatest(F.get(row, j), F.get(done, j - 1))))

        return F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(0)), cell)

    last = F.aggregate(F.split(x, ""), F.array_repeat(F.lit(0), n + 1), next_row)
    return F.when((F.length(x) == 0) | (n == 0), F.lit(0)).otherwise(F.get(last, n))


def text_similarity(a: Column, b: Column) -> Column:
    """0..100 over word sets: the best match among the common words and both texts' words in order.

    Two strings match by insertions and deletions over both lengths: 200 * common letters / total length. A text
    whose words are all in the other one scores 100; nothing scores 0 without words. Case counts.
    """
    words = lambda t: F.array_sort(F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: w != "")))
    wa, wb = words(a), words(b)
    both = F.array_sort(F.array_intersect(wa, wb))
    base = F.array_join(both, " ")
    left = F.trim(F.concat_ws(" ", base, F.array_join(F.array_except(wa, wb), " ")))
    right = F.trim(F.concat_ws(" ", base, F.array_join(F.array_except(wb, wa), " ")))

    # The common words start both longer texts, so all their letters are common to them.
    shared = lambda x: F.lit(200.0) * F.length(base) / (F.length(base) + F.length(x))
    rest = lambda x: F.substring(x, F.length(base) + 1, F.length(x))
    whole = F.lit(200.0) * (F.length(base) + common_letters(rest(left), rest(right))) / (F.length(left) + F.length(right))
    best = F.when(F.size(both) > 0, F.greatest(whole, shared(left), shared(right))).otherwise(whole)
    within = (F.size(both) > 0) & ((F.size(both) == F.size(wa)) | (F.size(both) == F.size(wb)))
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0).when(within, 100.0).otherwise(best)


def match_rules(new: DataFrame, old: DataFrame) -> DataFrame:
    """(rule_id, old_id, method, similarity) for new rules with a partner in the old rulebook.

    The same rule_id wins; else the most similar guideline of the same context above the
    feature's threshold.
    """
    exact = new.select("rule_id").join(old.select("rule_id"), "rule_id").select(
        "rule_id", F.col("rule_id").alias("old_id"), F.lit("exact").alias("method"), F.lit(100.0).alias("similarity")
    )
    context = ["feature", "tone", "genre"]
    rest = new.join(exact.select("rule_id"), "rule_id", "left_anti").select("rule_id", *context, "guideline")
    other = old.filter(F.col("guideline") != "").select(*context, F.col("rule_id").alias("old_id"), F.col("guideline").alias("old_guideline"))
    scored = rest.join(other, context).withColumn("similarity", text_similarity(F.col("guideline"), F.col("old_guideline")))
    limit = F.coalesce(F.try_element_at(literal_map(MATCH_THRESHOLDS), F.col("feature")), F.lit(DEFAULT_THRESHOLD))
    best = skew.rank_rows(scored.filter(F.col("similarity") >= limit), ["rule_id"], [F.desc("similarity"), F.asc("old_id")], 1, "_r")
    return exact.unionByName(best.select("rule_id", "old_id", F.lit("similarity").alias("method"), "similarity"))


def conflict_action(new_conf: Column, old_conf: Column) -> Column:
    return F.when((new_conf < 0) & (old_conf < 0), "delete").when(new_conf < 0, "keep").otherwise("update")


def merge_rulebook(old: DataFrame, new: DataFrame) -> DataFrame:
    """The next rulebook with `action` (added, updated, kept, untouched); deleted rules are gone."""
    matches = match_rules(new, old).select("rule_id", "old_id")
    prior = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns])
    joined = new.join(matches, "rule_id", "left").join(prior, F.col("old_id") == F.col("o_rule_id"), "full")
    added, untouched = F.col("o_rule_id").isNull(), F.col("rule_id").isNull()
    action = (
        F.when(added, "added").when(untouched, "untouched").otherwise(conflict_action(F.col("confidence"), F.col("o_confidence")))
    )
    rows = joined.withColumn("action", action).filter(F.col("action") != "delete")
    use_old = F.col("action").isin("untouched", "keep")
    update = F.col("action") == "update"
    counts = ["total_count", "satisfied_count", "dissatisfied_count", "satisfied_weight", "dissatisfied_weight"]
    total = {c: F.when(update, F.col(c) + F.col(f"o_{c}")).when(use_old, F.col(f"o_{c}")).otherwise(F.col(c)) for c in counts}
    rows = rows.withColumns({f"t_{c}": e for c, e in total.items()})
    conf = confidence(*[F.col(f"t_{c}") for c in ("satisfied_weight", "dissatisfied_weight", "satisfied_count", "dissatisfied_count")])
    special = {
        "confidence": F.when(update, conf).when(use_old, F.col("o_confidence")).otherwise(F.col("confidence")),
        "positive_ratio": F.when(update, F.bround(F.col("t_satisfied_count") / F.col("t_total_count"), 2))
        .when(use_old, F.col("o_positive_ratio"))
        .otherwise(F.col("positive_ratio")),
        "created_at": F.coalesce("o_created_at", "created_at"),
        "examples": F.when(update, _last(F.concat(F.coalesce("o_examples", F.array()), F.coalesce("examples", F.array()))))
        .when(use_old, F.col("o_examples"))
        .otherwise(F.col("examples")),
        **{c: F.col(f"t_{c}") for c in counts},
    }
    names = {"update": "updated", "keep": "kept"}
    label = F.coalesce(F.try_element_at(literal_map(names), F.col("action")), F.col("action"))
    cols = [special[c].alias(c) if c in special else F.when(use_old, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in old.columns]
    return rows.select(*cols, label.alias("action"))


def _last(items: Column, k: int = KEEP_EXAMPLES) -> Column:
    return F.when(F.size(items) > k, F.slice(items, -k, k)).otherwise(items)


# --- initial rules, lookup, prompts --------------------------------------------------------------


def initial_rules(document: DataFrame, now: str = AS_OF) -> DataFrame:
    """Flat rules out of `context_rules`: map context -> map feature -> rule data.

    Context keys read tone_genre; a missing genre is "general". The guideline says
    "shorter" when one of the first three examples is under 80 % of its original's length.
    """
    flat = document.select("created_at", F.explode("context_rules").alias("key", "features")).select(
        "created_at", F.split("key", "_").alias("parts"), F.explode("features").alias("feature", "data")
    )
    tone = F.col("parts")[0]
    genre = F.when(F.size("parts") >= 2, F.get("parts", F.lit(1))).otherwise("general")
    examples = F.coalesce(F.col("data.examples"), F.array())
    shorter = F.exists(F.slice(F.col("data.examples"), 1, 3), lambda e: F.length(e["selected"]) < F.length(e["original"]) * 0.8)
    guideline = F.when(F.size(F.col("data.examples")) > 0, F.when(shorter, SHORTER).otherwise(PREFERENCE)).otherwise(NO_EXAMPLES)
    n = F.coalesce(F.col("data.selection_count"), F.lit(0))
    return flat.select(
        rule_id(F.col("feature"), tone, genre).alias("rule_id"),
        "feature",
        tone.alias("tone"),
        genre.alias("genre"),
        guideline.alias("guideline"),
        F.coalesce(F.col("data.confidence"), F.lit(0.6)).alias("confidence"),
        F.coalesce(F.col("data.total_samples"), F.lit(0)).alias("total_count"),
        n.alias("satisfied_count"),
        F.lit(0).alias("dissatisfied_count"),
        n.cast("double").alias("satisfied_weight"),
        F.lit(0.0).alias("dissatisfied_weight"),
        F.coalesce(F.col("data.selection_rate"), F.lit(0.0)).alias("positive_ratio"),
        F.coalesce(F.col("data.rule_id"), F.lit("")).alias("original_rule_id"),
        "created_at",
        tf.as_ts(now).alias("updated_at"),
        F.size(examples).alias("example_count"),
    )


def find_rules(rules: DataFrame, feature: str, tone: str, genre: str) -> DataFrame:
    return rules.filter((F.col("feature") == feature) & (F.col("tone") == tone) & (F.col("genre") == genre))


def prompt_blocks(rules: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """One text block per context of the vocabulary that has something to say.

    A rulebook has one rule per context (legacy ids aside), so a block's lines are few.
    """
    inside = F.col("feature").isin(FEATURES) & F.col("tone").isin(TONES) & F.col("genre").isin(GENRES)
    good, bad = F.col("confidence") >= min_confidence, F.col("confidence") < 0
    lines = rules.filter(inside).select(
        "feature",
        "tone",
        "genre",
        "rule_id",
        F.when(good & (F.col("guideline") != ""), F.array(F.concat(F.lit("- "), "guideline"))).alias("do"),
        F.when(bad, F.transform(F.filter("avoid_guidelines", lambda a: a != ""), lambda a: F.concat(F.lit("- "), a))).alias("avoid"),
    )
    in_order = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size(c) > 0, F.struct("rule_id", F.col(c).alias("l"))))), lambda x: x["l"]))
    blocks = lines.groupBy("feature", "tone", "genre").agg(in_order("do").alias("do"), in_order("avoid").alias("avoid"))
    head = F.concat(F.lit("### ["), F.concat_ws(" / ", "feature", "tone", "genre"), F.lit("] 사용자 피드백 기반 규칙"))
    section = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n{title}\n"), F.array_join(c, "\n")))
    text = F.concat_ws("\n", head, section("[선호 패턴]", "do"), section("[피해야 할 패턴]", "avoid"))
    filled = blocks.filter((F.size("do") > 0) | (F.size("avoid") > 0))
    return filled.select(rule_id(F.col("feature"), F.col("tone"), F.col("genre")).alias("rule_id"), text.alias("prompt"))
