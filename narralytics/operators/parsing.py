"""Parse-and-audit jobs over model output: strict JSON, lenient JSON and two-line forms."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narralytics.constants import EMOTION_LABELS, PARSE_ERRORS
from narralytics.functions.text import collapse

NARRATIVE, LABEL = "predicted_narrative", "predicted_emotion_label"


def parse_strict(df: DataFrame, raw: str = "raw_generation", labels: Sequence[str] = tuple(EMOTION_LABELS)) -> DataFrame:
    """Adds narrative, label, ``parse_success`` and ``parse_error``; the first failing test names the error."""
    keys = F.sort_array(F.json_object_keys(F.col("_raw")))
    is_text = lambda name: F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant")) == "STRING"
    parsed = (df.withColumn("_raw", F.coalesce(F.col(raw), F.lit(""))).withColumn("_v", F.try_parse_json("_raw"))
              .withColumn("_kind", F.schema_of_variant("_v"))
              .withColumn("_n", collapse(F.try_variant_get("_v", f"$.{NARRATIVE}", "string")))
              .withColumn("_l", collapse(F.try_variant_get("_v", f"$.{LABEL}", "string"))))
    tests = [
        F.col("_v").isNull(), ~F.col("_kind").startswith("OBJECT"),
        ~F.coalesce(keys == F.array(F.lit(LABEL), F.lit(NARRATIVE)), F.lit(False)),
        ~F.coalesce(is_text(NARRATIVE), F.lit(False)), ~F.coalesce(is_text(LABEL), F.lit(False)),
        F.col("_n") == "", ~F.col("_l").isin(list(labels)),
    ]
    error = F.lit("")
    for test, code in reversed(list(zip(tests, PARSE_ERRORS))):
        error = F.when(test, F.lit(code)).otherwise(error)
    checked = parsed.withColumn("parse_error", error)
    ok = F.col("parse_error") == ""
    kept = [c for c in df.columns if c not in (NARRATIVE, LABEL, "parse_error", "parse_success")]
    return checked.select(*kept, F.when(ok, F.col("_n")).otherwise("").alias(NARRATIVE),
                          F.when(ok, F.col("_l")).otherwise("").alias(LABEL), ok.alias("parse_success"), "parse_error")


# fixed values: a field of an answer that is not JSON
LOOSE_FIELD = r'(?is)"?{name}"?\s*[:=]\s*"?(.*?)"?(?:,|\n|$)'


def _field(name: str) -> Column:
    """Loose field value from text that is not JSON, with quotes and commas removed."""
    value = F.regexp_replace(F.regexp_extract("_raw", LOOSE_FIELD.format(name=name), 1), r"^\s+|\s+$", "")
    value = F.trim(F.regexp_replace(value, "^,+|,+$", ""))
    value = F.rtrim(F.regexp_replace(value, r"\}$", ""))
    return collapse(F.regexp_replace(F.regexp_replace(value, '^"+|"+$', ""), "^'+|'+$", ""))


def parse_lenient(df: DataFrame, raw: str = "raw_generation") -> DataFrame:
    """Outermost ``{...}`` as JSON, else two loose field patterns; success when either is found."""
    prepared = (df.withColumn("_raw", F.coalesce(F.col(raw), F.lit("")))
                .withColumn("_object", F.regexp_extract("_raw", r"(?s)\{.*\}", 0)).withColumn("_v", F.try_parse_json("_object")))
    json = F.col("_v").isNotNull()
    pick = lambda name: F.when(json, collapse(F.get_json_object("_object", f"$.{name}"))).otherwise(_field(name))
    kept = [c for c in df.columns if c not in (NARRATIVE, LABEL, "parse_success")]
    out = prepared.select(*kept, pick(NARRATIVE).alias(NARRATIVE), pick(LABEL).alias(LABEL))
    return out.withColumn("parse_success", (F.col(NARRATIVE) != "") | (F.col(LABEL) != ""))


def parse_two_line(df: DataFrame, raw: str = "raw_generation", form: str = "joint",
                   labels: Sequence[str] = tuple(EMOTION_LABELS)) -> DataFrame:
    """Two-line outputs. ``joint`` and ``marker`` must match exactly, ``loose`` takes what it finds,
    ``label`` wants a vocabulary label as the whole text or its first line."""
    text = F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), r"(?U)^\s+|\s+$", "")
    plain = F.coalesce(F.col(raw), F.lit(""))
    if form == "joint":
        pattern = rf"\AEmotion: ({'|'.join(labels)})\nNarrative: (.+)\z"
        label, narrative = F.regexp_extract(text, pattern, 1), F.trim(F.regexp_extract(text, pattern, 2))
    elif form == "marker":
        label, narrative = F.lit(""), F.trim(F.regexp_extract(text, r"\AMarker: X\nNarrative: (.+)\z", 1))
    elif form == "loose":
        said = F.lower(F.trim(F.regexp_extract(plain, r"Emotion:\s*(.+)", 1)))
        label = F.lit("")
        for name in reversed(list(labels)):
            label = F.when(said.startswith(name.lower()), F.lit(name)).otherwise(label)
        tail = F.regexp_extract(plain, r"(?s)Narrative:(.*)", 1)
        rest = F.regexp_replace(plain, r"\A\s*Emotion:.*(?:\n|\z)", "")
        narrative = F.regexp_replace(F.when(plain.contains("Narrative:"), tail).otherwise(rest), r"(?U)^\s+|\s+$", "")
    elif form == "label":
        first = F.trim(F.regexp_extract(text, r"\A([^\n\r]*)", 1))
        label, narrative = F.when(first.isin(list(labels)), first).otherwise(F.lit("")), F.lit("")
    else:
        raise ValueError(f"unknown form {form!r}")
    kept = [c for c in df.columns if c not in (NARRATIVE, LABEL, "parse_success")]
    out = df.select(*kept, narrative.alias(NARRATIVE), label.alias(LABEL))
    return out.withColumn("parse_success", (F.col(NARRATIVE) != "") | (F.col(LABEL) != ""))


def parse_report(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("parse_error").agg(F.count("*").alias("n"))
