"""Analyses of lyrics as JSON: which have the right shape, and the text that is embedded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The paths that an analysis must have, and what stands there.
SHAPE = (("subject_paragraph", "string"), ("subject_tags", "array"), ("listener_feel_generic", "object"), ("tones", "array"), ("language", "string"), ("narrative_pov", "string"))
ANALYSIS = "subject_paragraph string, subject_tags array<string>, listener_feel_generic struct<primary_emotion: string>, tones array<string>, language string, narrative_pov string"


def _kind(value: Column) -> Column:
    """What a JSON value is: string, array, object (an array is one too), null or other; null where there is none."""
    schema = F.schema_of_variant(value)
    return F.when(schema == "STRING", "string").when(schema.startswith("ARRAY"), "array").when(schema.startswith("OBJECT"), "object").when(schema == "VOID", "null").otherwise(F.when(schema.isNotNull(), "other"))


def validate_analysis(df: DataFrame, json: str) -> DataFrame:
    """df with valid, reasons and analysis.

    reasons names each bad path and what should stand there, in the order of SHAPE ("$: object" alone where the text isn't a
    JSON object: null, broken or of another kind); valid rows have none. analysis holds the parsed values of valid rows,
    else null; array members that aren't strings stand there as their JSON. A list will do for listener_feel_generic.
    """
    value = F.try_parse_json(F.col(json))
    whole = F.coalesce(_kind(value) == "object", F.lit(False))
    bad = []
    for name, kind in SHAPE:
        found = _kind(F.try_variant_get(value, f"$.{name}", "variant"))
        right = found.isin("object", "array") if kind == "object" else found == kind
        bad.append(F.when(~F.coalesce(right, F.lit(False)), F.lit(f"$.{name}: {kind}")))
    reasons = F.when(whole, F.array_compact(F.array(*bad))).otherwise(F.array(F.lit("$: object")))
    out = df.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0)
    return out.withColumn("analysis", F.when(F.col("valid"), F.from_json(F.col(json), ANALYSIS, {"mode": "PERMISSIVE"})))


def analysis_text(paragraph: Column, tones: Column, feel: Column) -> Column:
    """The text that stands for an analysis among vectors: its paragraph, tones (a JSON list) and main emotion (of a JSON object).

    Broken JSON counts as empty; a null paragraph gives null."""
    words = F.coalesce(F.array_join(F.from_json(tones, "array<string>"), " ", ""), F.lit(""))
    emotion = F.coalesce(F.get_json_object(feel, "$.primary_emotion"), F.lit(""))
    return F.trim(F.concat(paragraph, F.lit(" "), words, F.lit(" "), emotion))
