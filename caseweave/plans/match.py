"""Matching labels of the part catalogue to canonical activities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match as M
from ..session import store
from .base import cte, register, table

VERBS = {
    "MEDIUM": "Ship",
    "STANDARD": "Shipped the",
    "LARGE": "Cancel PO for",
    "PROMO": "Cancelled",
    "SMALL": "shippingOf",
    "ECONOMY": "VL01N",
}


def labels(spark, d):
    verb = F.col("p_type")
    for kind, text in VERBS.items():
        verb = F.when(F.col("p_type") == kind, F.lit(text)).otherwise(verb)
    stage = F.when(F.col("p_size") % 3 == 0, F.lit("Complete ")).when(F.col("p_size") % 3 == 1, F.lit("start"))
    return table(spark, d, "part").select(F.concat_ws(" ", verb, "p_name").alias("label"), stage.alias("lifecycle"))


def texts(spark, d):
    """Canonical activities per product noun, from the catalogue itself."""
    noun = F.element_at(F.split("p_name", " "), -1)
    none = F.lit(None).cast("string")

    def row(prefix: str, text, method: str, lifecycle=none):
        return F.struct(
            F.concat(F.lit(prefix), F.col("noun")).alias("activity_id"), text.alias("text"), F.lit(method).alias("method"), lifecycle.alias("lifecycle")
        )

    def named(prefix: str):
        return F.concat(F.lit(prefix), F.col("noun"))

    items = [
        row("ship_", named("Ship "), "name"),
        row("ship_", named("Send "), "synonym"),
        row("ship_", F.lit("VL01N"), "code"),
        row("cancel_", named("Cancel purchase order for "), "label", F.lit("complete")),
        row("cancel_", named("Cancellation of "), "synonym"),
    ]
    nouns = table(spark, d, "part").select(noun.alias("noun")).distinct()
    return nouns.select(F.inline(F.array(*items)))


# --------------------------------------------------------------------------- the same in SQL
def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _stem_sql(t: str) -> str:
    cut = f"CASE {' '.join(f'''WHEN ends_with({t}, '{s}') AND length({t}) - {len(s)} >= 3 THEN substr({t}, 1, length({t}) - {len(s)}) || '{'i' if s == 'ies' else ''}' ''' for s in M.SUFFIXES)} ELSE {t} END"
    no_e = f"CASE WHEN ends_with({cut}, 'e') AND length({cut}) > 3 THEN regexp_replace({cut}, 'e$', '') ELSE {cut} END"
    no_y = f"CASE WHEN ends_with({no_e}, 'y') AND length({no_e}) > 3 THEN regexp_replace({no_e}, 'y$', 'i') ELSE {no_e} END"
    fixed = " ".join(f"WHEN {t} = '{a}' THEN '{b}'" for a, b in M.IRREGULAR.items())
    return f"CASE {fixed} ELSE {no_y} END"


_SEP = M.SEPARATORS.replace("'", "''")
_CODE = f"t IN ({_in(M.TRANSACTION_CODES)}) OR regexp_matches(t, '{M.CODE_PATTERN}')"


def _tokens_sql(source: str, text: str, prefix: str) -> str:
    spell = " ".join(f"WHEN t = '{a}' THEN string_split('{b}', ' ')" for a, b in M.ABBREVIATIONS.items())
    return (
        f"SELECT *, array_to_string({prefix}list, ' ') AS {prefix}norm, list_distinct({prefix}list) AS {prefix}tokens FROM (SELECT *, list_transform(flatten(list_transform(list_filter(raw, lambda t: NOT ({_CODE})),"
        f" lambda t: CASE {spell} WHEN t IN ({_in(M.STOP_WORDS)}) THEN [] ELSE [t] END)), lambda t: {_stem_sql('t')}) AS {prefix}list, list_distinct(list_filter(raw, lambda t: {_CODE})) AS {prefix}codes FROM"
        f" (SELECT *, list_filter(string_split_regex(lower(regexp_replace({text}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '{_SEP}'), lambda t: t <> '') AS raw FROM {source}))"
    )


cte(
    "obs",
    "SELECT DISTINCT CASE p_type "
    + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in VERBS.items())
    + " END || ' ' || p_name AS label, CASE p_size % 3 WHEN 0 THEN 'Complete ' WHEN 1 THEN 'start' END AS lifecycle FROM part",
)
cte("nouns", "SELECT DISTINCT string_split(p_name, ' ')[-1] AS noun FROM part")
cte(
    "txt",
    "SELECT 'ship_' || noun AS activity_id, 'Ship ' || noun AS text, 'name' AS method, NULL::VARCHAR AS c_lifecycle FROM nouns UNION ALL SELECT 'ship_' || noun, 'Send ' || noun, 'synonym', NULL FROM nouns UNION ALL"
    " SELECT 'ship_' || noun, 'VL01N', 'code', NULL FROM nouns UNION ALL SELECT 'cancel_' || noun, 'Cancel purchase order for ' || noun, 'label', 'complete' FROM nouns UNION ALL"
    " SELECT 'cancel_' || noun, 'Cancellation of ' || noun, 'synonym', NULL FROM nouns",
    "nouns",
)
cte("obs_t", _tokens_sql("obs", "label", "o_"), "obs")
cte("txt_t", _tokens_sql("txt", "text", "c_"), "txt")
cte(
    "mscore",
    "SELECT *, CASE WHEN lifecycle IS NOT NULL AND c_lifecycle IS NOT NULL AND lower(trim(lifecycle)) <> lower(trim(c_lifecycle)) THEN 0.0 ELSE base * CASE WHEN c_lifecycle IS NOT NULL AND lifecycle IS NULL THEN 0.9 ELSE 1.0 END END AS confidence FROM ("
    "SELECT *, CASE WHEN method = 'code' THEN CASE WHEN len(c_codes) > 0 AND list_has_all(o_codes, c_codes) THEN 0.97 ELSE 0.0 END WHEN o_norm <> '' AND o_norm = c_norm THEN CASE method WHEN 'label' THEN 1.0 ELSE 0.95 END"
    " WHEN len(o_tokens) > 0 AND len(c_tokens) > 0 THEN least(0.9, greatest((0.5 * 2 * common / (len(o_tokens) + len(c_tokens)) + 0.5 * common / least(len(o_tokens), len(c_tokens))) * pen, CASE WHEN ratio >= 0.72 THEN ratio * 0.9 * pen ELSE 0 END)) ELSE 0.0 END AS base FROM ("
    "SELECT *, len(list_intersect(o_tokens, c_tokens)) AS common, 1 - levenshtein(o_norm, c_norm) / greatest(length(o_norm), length(c_norm)) AS ratio, pow(0.7, len(list_filter(list_concat("
    "list_filter(o_tokens, lambda t: NOT list_contains(c_tokens, t)), list_filter(c_tokens, lambda t: NOT list_contains(o_tokens, t))), lambda t: t IN ("
    + _in(M.MARKERS)
    + ")))) AS pen FROM obs_t CROSS JOIN txt_t))",
    "obs_t",
    "txt_t",
)
cte(
    "matched",
    "SELECT label, lifecycle, activity_id, confidence, method, text AS matched_text, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS tier, rank FROM (SELECT *,"
    " row_number() OVER (PARTITION BY label, lifecycle ORDER BY round(confidence, 9) DESC, nt, activity_id) AS rank FROM (SELECT *, len(c_tokens) AS nt, row_number() OVER (PARTITION BY label, lifecycle, activity_id ORDER BY round(confidence, 9) DESC, len(c_tokens), text, method) AS r"
    " FROM mscore WHERE confidence >= 0.3) WHERE r = 1) WHERE rank <= 5",
    "mscore",
)


def matches(spark, d, **kw):
    return M.match(labels(spark, d), texts(spark, d), components=["lifecycle"], **kw)


@register(
    "M1_normalised_labels",
    "SELECT DISTINCT label, o_norm AS norm, array_to_string(o_codes, ',') AS codes FROM obs_t",
    with_=["obs_t"],
)
def _(spark, d):
    out = M.with_tokens(labels(spark, d).select("label").distinct(), "label", "o_")
    return out.select("label", F.col("o_norm").alias("norm"), F.array_join("o_codes", ",").alias("codes"))


@register("M1_match", "SELECT * FROM matched", doubles="confidence", with_=["matched"])
def _(spark, d):
    return matches(spark, d)


@register(
    "M2_match_evaluation",
    "SELECT count(*) AS n, avg(one) AS top1_rate, avg(three) AS top3_rate FROM (SELECT c.label, max(CASE WHEN m.activity_id = expected AND rank = 1 THEN 1 ELSE 0 END) AS one,"
    " max(CASE WHEN m.activity_id = expected AND rank <= 3 THEN 1 ELSE 0 END) AS three FROM (SELECT DISTINCT label, CASE WHEN lower(label) LIKE 'cancel%' THEN 'cancel_' ELSE 'ship_' END || string_split(label, ' ')[-1] AS expected FROM obs) c"
    " LEFT JOIN matched m ON m.label = c.label AND m.lifecycle IS NULL GROUP BY c.label)",
    doubles="top1_rate top3_rate",
    with_=["obs", "matched"],
)
def _(spark, d):
    found = store(matches(spark, d).where(F.col("lifecycle").isNull()))
    noun = F.element_at(F.split("label", " "), -1)
    verb = F.when(F.lower("label").startswith("cancel"), "cancel_").otherwise("ship_")
    curated = labels(spark, d).select("label").distinct().withColumn("expected", F.concat(verb, noun))
    return M.evaluate(found, curated)
