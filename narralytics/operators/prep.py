"""Training-table preparation: deduplication, splits, pairing, label controls and length audits."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narralytics.constants import EMOTION_LABELS, LENGTH_LIMITS
from narralytics.functions.text import collapse, first_tokens, key_digest, tokens_13a
from narralytics.operators.align import ValidationError, require_unique
from narralytics.operators.label_metrics import label_distribution
from narralytics.operators.ranking import percentiles, rank_by_hash, rank_by_value
from narralytics.session import small_side, stored, with_once

MAX_LABELS = 1000  # labels a relabelling may have; its plan has one run per pair of them


def required_rows(df: DataFrame, text: str, label: str, labels: Sequence[str] = tuple(EMOTION_LABELS),
                  check: bool = True) -> DataFrame:
    """Rows with text and label after normalisation; an unknown label is an error."""
    clean = with_once(df, **{text: collapse(F.col(text)), label: collapse(F.col(label))})
    kept = clean.where((F.col(text) != "") & (F.col(label) != ""))
    if check:
        other = ~F.col(label).isin(list(labels))
        # the labels alone are read first; texts matter only when some label is unknown
        suspect = df.select(collapse(F.col(label)).alias(label)).where((F.col(label) != "") & other).take(1)
        unknown = kept.where(other).select(label).distinct().take(10) if suspect else []
        if unknown:
            raise ValidationError(f"unknown labels {[r[0] for r in unknown]}")
    return kept


def blank_counts(df: DataFrame, text: str) -> DataFrame:
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    return df.agg(F.count("*").alias("rows"), F.count_if(blank).alias("missing"))


def drop_blank(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(text, F.trim(F.coalesce(F.col(text), F.lit("")))).where(F.col(text) != "")


def keep_first(df: DataFrame, text: str, ordinal: str) -> DataFrame:
    """First row of every match key. Keys are pre-aggregated as digests, so a text repeated in a
    third of the rows costs one small record per task; ``ordinal`` must be unique."""
    first = df.groupBy(key_digest(F.col(text)).alias("_key")).agg(F.min(ordinal).alias(ordinal))
    return df.join(first.select(ordinal), ordinal, "left_semi")


def _assigned_split(keys: DataFrame, label: str, ordinal: str, fraction: float, seed: int) -> DataFrame:
    """(ordinal, split) of a stored table of ids and labels."""
    sizes = keys.groupBy(label).agg(F.count("*").alias("_n"))
    quota = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(fraction)).cast("long"))
    quotas = small_side(sizes.select(F.col(label).alias("_label"), quota.alias("_quota")))
    ranked = rank_by_hash(keys.select(ordinal, label), [ordinal], seed, [label], "_rank").join(quotas, F.col(label).eqNullSafe(F.col("_label")))
    return ranked.select(ordinal, F.when(F.col("_rank") <= F.col("_quota"), "validation").otherwise("train").alias("split"))


def stratified_split(df: DataFrame, label: str, ordinal: str, fraction: float = 0.05, seed: int = 42) -> DataFrame:
    """Adds ``split``: per label the first max(1, round(n * fraction)) rows in hash order validate.

    Ids and labels are written once and ranked; the texts meet their split in one join.
    """
    keys = stored(df.select(ordinal, label), "split-keys")
    return df.join(_assigned_split(keys, label, ordinal, fraction, seed), ordinal).select(*df.columns, "split")


def deduplicated_split(df: DataFrame, text: str, label: str, ordinal: str, fraction: float = 0.05, seed: int = 42) -> DataFrame:
    """``keep_first`` and ``stratified_split`` in one: two passes over the texts, one for the digests of their
    match keys and one for the join with the split."""
    keys = stored(df.select(ordinal, label, key_digest(F.col(text)).alias("_key")), "split-keys")
    first = keys.groupBy("_key").agg(F.min(ordinal).alias(ordinal)).select(ordinal)
    split = _assigned_split(keys.join(first, ordinal, "left_semi"), label, ordinal, fraction, seed)
    return df.join(split, ordinal).select(*df.columns, "split")


def split_summary(source: DataFrame, required: DataFrame, split: DataFrame, label: str, narrative: str,
                  labels: Sequence[str] = tuple(EMOTION_LABELS)) -> DataFrame:
    """Long table of row counts per preparation step and of the label counts per split."""
    def row(df: DataFrame, name: str, count: Column | None = None) -> DataFrame:
        return df.agg((count if count is not None else F.count("*")).alias("value")).select(F.lit(name).alias("item"), "value")

    steps = split.agg(
        F.count("*").alias("rows_after_deduplication"),
        *[F.count_if((F.col("split") == s) & keep).alias(f"{task}_{s}_rows")
          for task, keep in (("label", F.lit(True)), ("narrative", F.coalesce(F.col(narrative), F.lit("")) != ""))
          for s in ("train", "validation")])
    counts = steps.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("item"), F.col(c).alias("value")) for c in steps.columns])).alias("r")).select("r.*")
    per_label = label_distribution(split, label, labels, ["split"]).select(
        F.concat_ws("_", "split", "label").alias("item"), F.col("n").alias("value"))
    return (row(source, "source_rows").unionByName(row(required, "rows_after_required_field_filter"))
            .unionByName(counts).unionByName(per_label))


def alpaca_rows(df: DataFrame, system: str, instruction: str, source: str, output: str) -> DataFrame:
    return df.select(F.lit(system).alias("system"), F.lit(instruction).alias("instruction"),
                     F.col(source).alias("input"), F.col(output).alias("output"))


def unique_index(df: DataFrame, text: str, check: bool = True) -> DataFrame:
    """Adds the digest key and insists that it is unique."""
    keyed = df.withColumn("_key", key_digest(F.col(text)))
    return require_unique(keyed, ["_key"], "narrative rows") if check else keyed


def pair_tasks(labels: DataFrame, narratives: DataFrame, check: bool = True) -> DataFrame:
    """Label rows joined to the narrative row of the same source; unmatched rows get null."""
    left = labels.withColumn("_key", key_digest(F.col("input")))
    right = unique_index(narratives, "input", check).select(
        "_key", F.col("output").alias("reference_narrative"), F.col("system").alias("narrative_system"),
        F.col("instruction").alias("narrative_instruction"))
    return left.join(right, "_key", "left").select(
        F.col("input").alias("source_text"), F.col("output").alias("emotion_label"), "reference_narrative",
        F.col("system").alias("label_system"), F.col("instruction").alias("label_instruction"),
        "narrative_system", "narrative_instruction")


def pairing_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("label_rows"), F.count("reference_narrative").alias("paired_rows"),
                     F.count_if(F.col("reference_narrative").isNull()).alias("label_rows_without_narrative"))


def target_head(condition: Column, label: Column, wrong_label: Column) -> Column:
    """What stands before the narrative in a training target."""
    first = (F.when(condition == "marker_control", F.lit("Marker: X"))
             .when(condition == "constant_neutral", F.lit("Emotion: Neutral"))
             .when(condition == "forced_wrong", F.concat(F.lit("Emotion: "), wrong_label))
             .otherwise(F.concat(F.lit("Emotion: "), label)))
    return F.concat(first, F.lit("\nNarrative: "))


def target_text(condition: Column, label: Column, wrong_label: Column, narrative: Column) -> Column:
    """Two-line training target of a condition: true, forced_wrong, constant_neutral, marker_control."""
    return F.concat(target_head(condition, label, wrong_label), F.trim(narrative))


def target_tokens(df: DataFrame, conditions: Sequence[str], label: Column, wrong_label: Column, narrative: Column, n: str = "n") -> DataFrame:
    """A row per condition with the 13a token count of its ``target_text``. A head ends in a space and no token crosses one, so the
    narrative is counted once for all conditions."""
    own = F.size(tokens_13a(F.trim(narrative)))
    rows = with_once(df, _own=own).withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions])))
    head = target_head(F.col("condition"), label, wrong_label)
    return rows.withColumn(n, F.when(head.isNull() | narrative.isNull(), 0).otherwise(F.size(tokens_13a(head)) + F.col("_own"))).drop("_own")


def gold_prefix(label: Column, instruction: Column) -> Column:
    return F.concat(F.lit("The author's dominant emotion is "), label, F.lit(".\n"), instruction)


def task_rows(pairs: DataFrame, max_source_tokens: int, cutoff: int, tokenise=tokens_13a) -> DataFrame:
    """Two rows per pair (label, narrative) with token counts, capped at the cutoff length.

    Both prompts end with the same source on its own line, so with the default tokeniser, whose tokens never cross a line, its
    tokens are counted once for both; a head that ends in a hyphen would draw the next line to itself and is counted with its source.
    """
    tokens = with_once(pairs, _source=tokenise(F.col("source_text")))
    long = F.size("_source") > max_source_tokens
    cut = with_once(tokens, truncated=long, _text=F.when(long, first_tokens(F.col("_source"), max_source_tokens)).otherwise(F.col("source_text")))
    count = lambda text: F.size(tokenise(text))
    sized_text = with_once(cut, _tokens=F.when(F.col("truncated"), count(F.col("_text"))).otherwise(F.size("_source"))).drop("_source")
    both = sized_text.select(*pairs.columns, "truncated", "_text", "_tokens", F.explode(F.array(*[
        F.struct(F.lit(task).alias("task"), F.col(f"{task}_system").alias("system"), F.col(f"{task}_instruction").alias("instruction"), F.col(target).alias("target"))
        for task, target in (("label", "emotion_label"), ("narrative", "reference_narrative"))])).alias("t"))
    key = [c for c in pairs.columns if c in ("sample_id", "split")]
    prompt = F.concat(F.col("t.instruction"), F.lit("\n"), F.col("_text"))
    whole = count(F.concat_ws("\n", "t.system", prompt))
    if tokenise is tokens_13a:
        head = F.concat_ws("\n", "t.system", "t.instruction")
        drawn = F.endswith(F.replace(head, F.lit("<skipped>"), F.lit("")), F.lit("-"))
        whole = F.when(prompt.isNull() | drawn, whole).otherwise(count(head) + F.col("_tokens"))
    sized = with_once(both, prompt_tokens=whole, _target=count(F.col("t.target"))).select(
        *key, "truncated", "t.task", prompt.alias("prompt"), "t.target", "prompt_tokens", "_target")
    sequence = F.least(F.col("prompt_tokens") + F.col("_target"), F.lit(cutoff))
    return sized.withColumn("sequence_tokens", sequence).withColumn(
        "target_tokens", F.greatest(F.col("sequence_tokens") - F.col("prompt_tokens"), F.lit(0))).drop("_target")


def task_summary(rows: DataFrame) -> DataFrame:
    def of(task: str, value: Column) -> Column:
        return F.when(F.col("task") == task, value)

    return rows.agg(
        F.count_if(F.col("task") == "label").alias("paired_rows"), F.count("*").alias("sequences"),
        F.count_if((F.col("task") == "label") & F.col("truncated")).alias("truncated_sources"),
        F.avg(of("label", F.col("target_tokens"))).alias("label_target_tokens_mean"),
        F.avg(of("narrative", F.col("target_tokens"))).alias("narrative_target_tokens_mean"),
        F.max(of("label", F.col("sequence_tokens"))).alias("label_sequence_tokens_max"),
        F.max(of("narrative", F.col("sequence_tokens"))).alias("narrative_sequence_tokens_max"))


def length_profile(df: DataFrame, length: str, by: Sequence[str] = (), limits: Sequence[int] = tuple(LENGTH_LIMITS)) -> DataFrame:
    """Rows, extremes, exact percentiles and rows over the limits, per group; lengths are measured once and written."""
    sized, n = stored(df.select(*by, length), "lengths"), F.col(length)
    plain = sized.groupBy(*by).agg(F.count("*").alias("rows"), F.min(n).alias("minimum"), F.max(n).alias("maximum"),
                                   *[F.count_if(n > limit).alias(f"over_{limit}") for limit in limits])
    found = percentiles(sized, [length], [0.5, 0.9, 0.95, 0.99], by)
    same = reduce(lambda a, b: a & b, [plain[c].eqNullSafe(found[c]) for c in by], F.lit(True))
    return plain.join(found, same, "left").select(
        *[plain[c] for c in by], "rows", "minimum", F.col("p0").alias("median"), F.col("p1").alias("p90"), F.col("p2").alias("p95"), F.col("p3").alias("p99"),
        "maximum", *[f"over_{limit}" for limit in limits])


def length_deltas(lengths: DataFrame, baseline: str, cutoff: int, key: str = "sample_id") -> DataFrame:
    """Per condition: spread of the length change against the baseline and changed cutoff status; lengths are measured once and written."""
    lengths = stored(lengths.select(key, "condition", "n"), "lengths")
    base = lengths.where(F.col("condition") == baseline).select(key, F.col("n").alias("_base"))
    others = lengths.where(F.col("condition") != baseline).join(base, key).withColumn("_d", F.col("n") - F.col("_base"))
    return others.groupBy("condition").agg(
        F.min("_d").alias("minimum_delta"), F.percentile("_d", F.lit(0.5)).alias("median_delta"), F.max("_d").alias("maximum_delta"),
        F.count_if((F.col("n") > cutoff) != (F.col("_base") > cutoff)).alias("different_cutoff_rows"))


def mutual_information(df: DataFrame, left: str, right: str) -> DataFrame:
    """Mutual information in nats and its sqrt(H*H)-normalised form, from one contingency table."""
    cells = contingency(df, left, right)
    # windows over the contingency table: one row per label pair
    n = F.sum("n").over(Window.partitionBy())
    parts = cells.select(
        F.col("n").alias("_n"), n.alias("_total"), F.sum("n").over(Window.partitionBy("left")).alias("_l"),
        F.sum("n").over(Window.partitionBy("right")).alias("_r"))
    p = F.col("_n") / F.col("_total")
    joint = p * F.ln(p / (F.col("_l") / F.col("_total") * F.col("_r") / F.col("_total")))
    entropy = lambda c: -p * F.ln(F.col(c) / F.col("_total"))
    sums = parts.agg(F.sum(joint).alias("information"), F.sum(entropy("_l")).alias("_hl"), F.sum(entropy("_r")).alias("_hr"))
    return sums.select("information", (F.col("information") / F.sqrt(F.col("_hl") * F.col("_hr"))).alias("normalized"))


def contingency(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.groupBy(F.col(left).alias("left"), F.col(right).alias("right")).agg(F.count("*").alias("n"))


def contingency_wide(df: DataFrame, left: str, right: str, labels: Sequence[str]) -> DataFrame:
    return contingency(df, left, right).groupBy("left").pivot("right", list(labels)).agg(F.sum("n")).na.fill(0)


def label_change_counts(df: DataFrame, before: str, after: str) -> DataFrame:
    """Per label: rows before, rows after and rows that kept it."""
    same = F.col(before) == F.col(after)
    roles = df.select(F.explode(F.array(
        F.struct(F.col(before).alias("label"), F.lit(1).alias("b"), F.lit(0).alias("a"), same.cast("int").alias("m")),
        F.struct(F.col(after).alias("label"), F.lit(0).alias("b"), F.lit(1).alias("a"), F.lit(0).alias("m")))).alias("r")).select("r.*")
    return roles.groupBy("label").agg(F.sum("b").alias("before"), F.sum("a").alias("after"), F.sum("m").alias("matches"))


def permute_labels(df: DataFrame, label: str, ordinal: str, seed: int = 1234, out: str = "permuted") -> DataFrame:
    """Random permutation of a label column: the row of rank r takes the label of the r-th hash."""
    by_row = rank_by_value(df, ordinal, out="_rank")
    by_hash = rank_by_hash(df.select(ordinal, label), [ordinal], seed, out="_rank").select("_rank", F.col(label).alias(out))
    return by_row.join(by_hash, "_rank").select(*df.columns, out)


def plan_derangement(counts: dict[str, int], seed: int, candidates: int = 128) -> dict[tuple[str, str], int]:
    """Cell counts (true, assigned) of a random relabelling without matches and with equal marginals.

    Only the label-by-label table is random; it is drawn as a shuffle would make it, its diagonal is
    emptied by swaps, and the candidate with the least mutual information wins. The table has one
    cell per label pair, so this is independent of the number of rows.
    """
    names = sorted(counts)
    sizes = np.array([counts[x] for x in names])
    total = int(sizes.sum())
    if 2 * sizes.max() > total:
        raise ValidationError("one label holds more than half of the rows: no relabelling without matches exists")
    best, best_information = None, np.inf
    for candidate in range(candidates):
        rng = np.random.default_rng([seed, candidate])
        left, table = sizes.copy(), np.zeros((len(names), len(names)), dtype=np.int64)
        for i, size in enumerate(sizes):
            table[i] = rng.multivariate_hypergeometric(left, size, method="marginals")
            left = left - table[i]
        while table.diagonal().any():
            a = int(table.diagonal().argmax())
            others = table.copy()
            others[a, :], others[:, a] = 0, 0
            b, c = divmod(int(rng.choice(others.size, p=others.ravel() / others.sum())), len(names))
            moved = int(min(table[a, a], max(1, table[b, c] // 2)))
            table[a, a] -= moved
            table[b, c] -= moved
            table[a, c] += moved
            table[b, a] += moved
        p = table / total
        outer = np.outer(sizes, sizes) / total**2
        information = float((p[p > 0] * np.log(p[p > 0] / outer[p > 0])).sum())
        if information < best_information:
            best, best_information = table, information
    return {(x, y): int(best[i, j]) for i, x in enumerate(names) for j, y in enumerate(names) if best[i, j]}


def forced_wrong_labels(df: DataFrame, label: str, ordinal: str, seed: int, candidates: int = 128,
                        out: str = "assigned") -> DataFrame:
    """Relabel every row with a wrong label, keeping all label frequencies.

    Rows of one label are put in hash order and handed out in runs of the planned cell sizes, so
    one ranking pass realises the plan whatever the table size.
    """
    keys = stored(df.select(ordinal, label), "relabel-keys")
    found = keys.groupBy(label).count().limit(MAX_LABELS + 1).collect()
    if len(found) > MAX_LABELS:
        raise ValidationError(f"{label} has more than {MAX_LABELS} labels")
    counts = {r[0]: r[1] for r in found}
    runs, filled = [], {}
    for (true, assigned), n in sorted(plan_derangement(counts, seed, candidates).items()):
        start = filled.get(true, 0)
        runs.append((true, start + 1, start + n, assigned))
        filled[true] = start + n
    table = df.sparkSession.createDataFrame(runs, "_label string, _first long, _last long, _assigned string")
    ranked = rank_by_hash(keys, [ordinal], seed, [label], "_rank")
    chosen = ranked.join(small_side(table, MAX_LABELS ** 2), (F.col(label) == F.col("_label")) & F.col("_rank").between(F.col("_first"), F.col("_last")))
    return df.join(chosen.select(ordinal, F.col("_assigned").alias(out)), ordinal).select(*df.columns, out)


def longest_first(df: DataFrame, text: str, ordinal: str, rows: int) -> DataFrame:
    return df.orderBy(F.length(text).desc(), ordinal).limit(rows)
