"""The logs the registered queries run on, and the registry itself.

Log ``w`` is the ``events`` table as it is: a case per user.  Log ``o`` joins
``orders`` and ``lineitem``: a case per order, one event for the order and one per
line.  The ``dirty`` variants plant the faults that the readiness checks look for,
by rules on the keys, written the same way in both languages.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import join_on
from ..operators.cases import build_cases, case_aggregates, right_censored
from ..operators.norm import Norm, count_name, evaluate, gather, load_norm, with_scores
from ..session import store, tune

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    make_sql: Callable[[], str | None]

    @property
    def sql(self) -> str | None:
        return self.make_sql()


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, *, doubles: str = "", decimals: int = 6, with_: Sequence[str] = ()):
    """Register a query; doubles are rounded alike on both sides before they are compared."""

    def wrap(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(tune(spark), sf_dir), decimals)

        def text() -> str | None:
            if sql is None:
                return None
            body = f"{ctes_for(with_)} {sql}".strip()
            reps = ", ".join(f"{rounded_sql(c, decimals)} AS {c}" for c in doubles.split())
            return f"SELECT * REPLACE ({reps}) FROM ({body}) AS q" if reps else body

        REGISTRY[name] = Entry(run, text)
        return fn

    return wrap


# Half-way values are common (amounts have two decimals), so the cut is moved off the half.
CUT = 0.50037


def rounded_sql(col: str, decimals: int) -> str:
    return f"floor(CAST({col} AS DOUBLE) * 1e{decimals} + {CUT}) / 1e{decimals} + 0.0"


def rounded(df: DataFrame, decimals: int) -> DataFrame:
    unit = 10.0**decimals
    cols = {n: F.floor(F.col(f"`{n}`") * unit + CUT).cast("double") / unit + F.lit(0.0) for n, t in df.dtypes if t == "double"}
    return df.withColumns(cols) if cols else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------- SQL building blocks
CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *uses: str) -> None:
    if name in CTE:
        raise ValueError(f"the name {name} is taken")
    CTE[name] = (uses, sql)


def ctes_for(names: Sequence[str]) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in order:
            for u in CTE[n][0]:
                visit(u)
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ", ".join(f"{n} AS ({CTE[n][1]})" for n in order) if order else ""


# --------------------------------------------------------------------------- log w
def log_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("case_id"),
        F.col("event_type").alias("activity"),
        "ts",
        F.col("event_id").alias("seq"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


cte(
    "w",
    "SELECT user_id AS case_id, event_type AS activity, ts, event_id AS seq, value,"
    " CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INTEGER) AS k FROM events",
)


def cases_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_cases(log_w(spark, sf_dir), attributes=["k"], exposure="value", exposure_agg="sum")


cte(
    "cw",
    "SELECT case_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts, sum(value) AS exposure,"
    " arg_min(k, (ts, seq)) AS k FROM w GROUP BY case_id",
    "w",
)


# --------------------------------------------------------------------------- log o
def log_o(spark: SparkSession, sf_dir: str, attributes: bool = True) -> DataFrame:
    """The orders log; without ``attributes`` the customer join is left out."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    if attributes:
        customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
        who = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
        orders = orders.join(who, orders.o_custkey == who.c_custkey, "left")
    case_columns = {"priority": "o_orderpriority", "status": "o_orderstatus", "segment": "c_mktsegment", "nation": "n_name"}
    case_columns = case_columns if attributes else {}
    placed = orders.select(
        F.col("o_orderkey").alias("case_id"),
        F.lit("Place order").alias("activity"),
        F.col("o_orderdate").alias("ts"),
        F.struct(
            F.lit(0).alias("line"),
            F.lit(0).cast("bigint").alias("part"),
            F.lit(0).cast("bigint").alias("supp"),
            F.lit(0.0).alias("price"),
        ).alias("seq"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_totalprice").alias("exposure"),
        *[F.col(c).alias(n) for n, c in case_columns.items()],
        F.lit(None).cast("string").alias("resource"),
        F.lit(None).cast("string").alias("linestatus"),
    )
    none = F.lit(None)
    moved = lines.select(
        F.col("l_orderkey").alias("case_id"),
        F.when(F.col("l_returnflag") == "R", "Return item").otherwise("Ship item").alias("activity"),
        F.col("l_shipdate").alias("ts"),
        F.struct(
            F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("part"),
            F.col("l_suppkey").alias("supp"),
            F.col("l_extendedprice").alias("price"),
        ).alias("seq"),
        F.col("l_extendedprice").alias("amount"),
        none.cast("double").alias("exposure"),
        *[none.cast("string").alias(c) for c in case_columns],
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("resource"),
        F.col("l_linestatus").alias("linestatus"),
    )
    return placed.unionByName(moved)


cte(
    "o",
    "SELECT o_orderkey AS case_id, 'Place order' AS activity, o_orderdate AS ts,"
    " {'line': 0, 'part': 0::BIGINT, 'supp': 0::BIGINT, 'price': 0.0::DOUBLE} AS seq, o_totalprice AS amount, o_totalprice AS exposure,"
    " o_orderpriority AS priority, o_orderstatus AS status, c_mktsegment AS segment, n_name AS nation,"
    " NULL::VARCHAR AS resource, NULL::VARCHAR AS linestatus"
    " FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey"
    " UNION ALL SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'Return item' ELSE 'Ship item' END, l_shipdate,"
    " {'line': l_linenumber, 'part': l_partkey, 'supp': l_suppkey, 'price': l_extendedprice}, l_extendedprice, NULL, NULL, NULL, NULL, NULL,"
    " 'S' || l_suppkey, l_linestatus FROM lineitem",
)

ATTRIBUTES_O = ("priority", "status", "segment", "nation")
WINDOW_END = "2001-08-01 00:00:00"
CENSOR_DAYS = 60


def aggregates_o(events: DataFrame) -> dict:
    return case_aggregates(events, attributes=ATTRIBUTES_O, exposure="exposure", exposure_agg="max")


def cases_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_cases(log_o(spark, sf_dir), attributes=ATTRIBUTES_O, exposure="exposure", exposure_agg="max")


cte(
    "co",
    "SELECT case_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts, max(exposure) AS exposure, "
    + ", ".join(f"arg_min({a}, (ts, seq)) FILTER (WHERE {a} IS NOT NULL) AS {a}" for a in ATTRIBUTES_O)
    + ", count(*) FILTER (WHERE activity = 'Ship item') AS n_ship,"
    " count(*) FILTER (WHERE activity = 'Return item') AS n_return,"
    " count(DISTINCT ts) AS n_stamps,"
    " min(ts) FILTER (WHERE activity = 'Place order') AS t_place,"
    " min(ts) FILTER (WHERE activity = 'Ship item') AS t_ship,"
    " min(ts) FILTER (WHERE activity = 'Return item') AS t_return FROM o GROUP BY case_id",
    "o",
)

# A norm with every constraint type, every missing policy, both kinds of view and
# every form of applicability.
NORM_DOC = {
    "layers": ["coverage", "timing", "quality", "value"],
    "scoring_mode": "layer_balanced",
    "window_end": WINDOW_END,
    "views": [
        {"name": "A", "layer_weights": {"coverage": 1, "timing": 2, "quality": 1, "value": 1}},
        {
            "name": "B",
            "constraint_weights": {
                "c_ship": 1,
                "c_noret": 3,
                "c_single": 1,
                "c_lag": 2,
                "c_each": 1,
                "c_prec": 0.5,
                "c_bal": 1,
            },
        },
    ],
    "constraints": [
        {"id": "c_ship", "layer": "coverage", "type": "presence", "params": {"activity": "Ship item"}},
        {
            "id": "c_lag",
            "layer": "timing",
            "type": "lag",
            "params": {"a": "Place order", "b": "Ship item", "delta": 90, "width": 365, "unit": "D"},
            "weight": 2,
        },
        {
            "id": "c_over",
            "layer": "timing",
            "type": "lag",
            "params": {
                "a": "Place order",
                "b": "Return item",
                "delta": 30,
                "width": 180,
                "unit": "D",
                "response": "first_overall",
                "missing_b": "censor",
            },
            "applicability": {"segment": ["BUILDING", "MACHINERY"]},
        },
        {
            "id": "c_each",
            "layer": "timing",
            "type": "lag",
            "params": {
                "a": "Ship item",
                "b": "Return item",
                "delta": 30,
                "width": 365,
                "unit": "D",
                "activation": "each",
                "missing_b": "skip",
            },
        },
        {
            "id": "c_prec",
            "layer": "timing",
            "type": "precedence",
            "params": {"a": "Place order", "b": "Ship item", "k": 0, "K": 2, "missing_b": "skip"},
        },
        {
            "id": "c_noret",
            "layer": "quality",
            "type": "exclusion",
            "params": {"activity": "Return item", "after": "Place order"},
            "applicability": {"attr": "status", "in": ["F", "O"]},
        },
        {
            "id": "c_single",
            "layer": "quality",
            "type": "singularity",
            "params": {"activity": "Ship item", "k": 2, "K": 3},
        },
        {
            "id": "c_bal",
            "layer": "value",
            "type": "balance",
            "params": {
                "attr_x": "amount",
                "activities_x": ["Ship item", "Return item"],
                "attr_y": "amount",
                "activities_y": ["Place order"],
                "tau": 0.1,
                "width": 0.5,
            },
        },
        {
            "id": "c_metric",
            "layer": "value",
            "type": "metric",
            "params": {"attribute": "exposure", "threshold": 300000, "width": 150000},
            "applicability": {"all": [{"attr": "priority", "not_in": ["5-LOW"]}, {"has": "Ship item"}]},
        },
    ],
}

KEEP_O = ("n_events", "first_ts", "last_ts", "exposure", *ATTRIBUTES_O, "n_stamps", "censored", "replicated")


def norm_o() -> Norm:
    return load_norm(NORM_DOC)


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make: Query) -> DataFrame:
    """An artefact that many reports read: written once per application, then scanned by column."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = store(make(spark, sf_dir))
    return _STORED[key]


def case_table_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "cases", cases_o)


def scored_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "scored", lambda s, d: score_table(log_o(s, d), norm_o(), bare=log_o(s, d, False)))


def stamps(events: DataFrame) -> DataFrame:
    """Distinct timestamps per case; kept apart from the other case aggregates, which need no distinct step."""
    per_stamp = events.where(F.col("ts").isNotNull()).groupBy("case_id", "ts").agg(F.lit(1).alias("one"))
    return per_stamp.groupBy("case_id").agg(F.sum("one").alias("n_stamps"))


def score_table(events: DataFrame, norm: Norm, extra: Sequence[str] = (), bare: DataFrame | None = None) -> DataFrame:
    """``bare`` may bring the same events without their attributes, which the stamps do not need."""
    aggs = aggregates_o(events)
    ship = count_name(["Ship item"])
    aggs.setdefault(ship, F.count_if(F.col("activity") == "Ship item"))
    rows = join_on(gather(events, norm, aggs), stamps(events if bare is None else bare), ["case_id"], "left")
    open_ = right_censored(F.col(ship), F.lit(WINDOW_END).cast("timestamp_ntz"), CENSOR_DAYS)
    rows = rows.withColumns(
        {"censored": open_, "replicated": F.coalesce(F.col("n_events") / F.col("n_stamps") > 2.0, F.lit(False))}
    )
    return with_scores(evaluate(rows, norm, [*KEEP_O, *extra]), norm)


cte(
    "resp_o",
    "SELECT e.case_id, min(e.ts) FILTER (WHERE e.activity = 'Ship item' AND e.ts >= c.t_place) AS t_resp,"
    " count(*) FILTER (WHERE e.activity = 'Ship item' AND e.ts < c.t_place) AS n_early,"
    " count(*) FILTER (WHERE e.activity = 'Return item' AND e.ts > c.t_place) AS n_scoped"
    " FROM o e JOIN co c USING (case_id) GROUP BY e.case_id",
    "o",
    "co",
)
cte(
    "each_o",
    "SELECT case_id, avg(lag) AS x_each, avg(CASE WHEN lag IS NOT NULL THEN least(1, greatest(0, (lag - 30) / 365.0)) END) AS v_each"
    " FROM (SELECT s.case_id, s.seq, (epoch_us(min(r.ts)) - epoch_us(s.ts)) / 86400000000.0 AS lag FROM o s"
    " LEFT JOIN o r ON r.case_id = s.case_id AND r.activity = 'Return item' AND r.ts >= s.ts"
    " WHERE s.activity = 'Ship item' GROUP BY s.case_id, s.seq, s.ts) GROUP BY case_id",
    "o",
)
DAY_US = "86400000000.0"
cte(
    "sig_o",
    "SELECT c.*, r.n_early, r.t_resp, e.v_each,"
    " CAST(c.n_ship AS DOUBLE) AS x_ship, CAST(r.n_scoped AS DOUBLE) AS x_noret, CAST(c.n_ship AS DOUBLE) AS x_single,"
    f" (epoch_us(r.t_resp) - epoch_us(c.t_place)) / {DAY_US} AS x_lag,"
    f" CASE WHEN c.t_return >= c.t_place THEN (epoch_us(c.t_return) - epoch_us(c.t_place)) / {DAY_US} END AS x_over,"
    " e.x_each, CAST(r.n_early AS DOUBLE) AS x_prec,"
    " abs(coalesce(b.tx, 0) - coalesce(b.ty, 0)) / greatest(coalesce(b.tx, 0), coalesce(b.ty, 0), 1e-9) AS x_bal,"
    " c.exposure AS x_metric FROM co c LEFT JOIN resp_o r USING (case_id) LEFT JOIN each_o e USING (case_id)"
    " LEFT JOIN (SELECT case_id, sum(amount) FILTER (WHERE activity <> 'Place order') AS tx,"
    " sum(amount) FILTER (WHERE activity = 'Place order') AS ty FROM o GROUP BY case_id) b USING (case_id)",
    "co",
    "resp_o",
    "each_o",
    "o",
)
CIDS = ("c_ship", "c_lag", "c_over", "c_each", "c_prec", "c_noret", "c_single", "c_bal", "c_metric")
LAYER_OF = {
    "c_ship": "coverage",
    "c_lag": "timing",
    "c_over": "timing",
    "c_each": "timing",
    "c_prec": "timing",
    "c_noret": "quality",
    "c_single": "quality",
    "c_bal": "value",
    "c_metric": "value",
}
cte(
    "vio_o",
    "SELECT *, TRUE AS s_ship, TRUE AS s_lag, segment IN ('BUILDING', 'MACHINERY') AS s_over, TRUE AS s_each, TRUE AS s_prec,"
    " status IN ('F', 'O') AS s_noret, TRUE AS s_single, TRUE AS s_bal, (priority <> '5-LOW' AND n_ship > 0) AS s_metric,"
    " CASE WHEN n_ship < 1 THEN 1.0 ELSE 0.0 END AS v_ship,"
    " CASE WHEN t_place IS NULL THEN NULL WHEN x_lag IS NULL THEN 1.0 ELSE least(1, greatest(0, (x_lag - 90) / 365.0)) END AS v_lag,"
    " CASE WHEN NOT segment IN ('BUILDING', 'MACHINERY') OR t_place IS NULL THEN NULL"
    " WHEN x_over IS NOT NULL THEN least(1, greatest(0, (x_over - 30) / 180.0)) WHEN t_return < t_place THEN NULL"
    f" ELSE least(1, greatest(0, ((epoch_us(TIMESTAMP '{WINDOW_END}') - epoch_us(t_place)) / {DAY_US} - 30) / 180.0)) END AS v_over,"
    " CASE WHEN n_ship > 0 THEN v_each END AS v_eachs,"
    " CASE WHEN n_ship > 0 AND t_place IS NOT NULL THEN least(1, n_early / 2.0) END AS v_prec,"
    " CASE WHEN status IN ('F', 'O') THEN CASE WHEN x_noret > 0 THEN 1.0 ELSE 0.0 END END AS v_noret,"
    " least(1, greatest(0, (n_ship - 2) / 3.0)) AS v_single,"
    " least(1, greatest(0, (x_bal - 0.1) / 0.5)) AS v_bal,"
    " CASE WHEN priority <> '5-LOW' AND n_ship > 0 THEN least(1, greatest(0, (exposure - 300000) / 150000.0)) END AS v_metric,"
    " (n_ship = 0 AND last_ts > TIMESTAMP '2001-06-02') AS censored, (n_events / n_stamps > 2.0) AS replicated FROM sig_o",
    "sig_o",
)
# View A: layer weights 1, 2, 1, 1; inside "timing" c_lag counts 2 and the others 1.
WEIGHTS = {
    "A": {"c_ship": 1.0, "c_lag": 0.8, "c_over": 0.4, "c_each": 0.4, "c_prec": 0.4, "c_noret": 0.5, "c_single": 0.5, "c_bal": 0.5, "c_metric": 0.5},
    "B": {"c_ship": 1.0, "c_lag": 2.0, "c_over": 0.0, "c_each": 1.0, "c_prec": 0.5, "c_noret": 3.0, "c_single": 1.0, "c_bal": 1.0, "c_metric": 0.0},
}


def vcol(cid: str) -> str:
    return "v_eachs" if cid == "c_each" else "v_" + cid[2:]


def scored_sql(weights: dict[str, dict[str, float]], source: str = "vio_o", mode: str = "layer_balanced") -> str:
    """Scores, contributions and penalties written out for given weights."""
    layers = ("coverage", "timing", "quality", "value")
    inner, outer = [], []
    for view, w in weights.items():
        live = {c: f"(CASE WHEN {vcol(c)} IS NOT NULL THEN {w[c]} ELSE 0.0 END)" for c in CIDS}
        for layer in layers:
            inner.append("(" + " + ".join(live[c] for c in CIDS if LAYER_OF[c] == layer) + f") AS e_{view}_{layer}")
    for view, w in weights.items():
        size = {layer: sum(w[c] for c in CIDS if LAYER_OF[c] == layer) for layer in layers}
        if mode == "flat":
            active = " + ".join(f"e_{view}_{layer}" for layer in layers)
        else:
            active = " + ".join(f"(CASE WHEN e_{view}_{layer} > 0 THEN {size[layer]} ELSE 0.0 END)" for layer in layers)
        pens = {}
        for c in CIDS:
            layer = LAYER_OF[c]
            part = f"{w[c]} / act_{view}" if mode == "flat" else f"{size[layer]} / act_{view} * {w[c]} / e_{view}_{layer}"
            pens[c] = f"(CASE WHEN {vcol(c)} IS NOT NULL AND e_{view}_{layer} > 0 THEN {part} * {vcol(c)} ELSE 0.0 END)"
        outer.append((view, active, pens))
    step1 = f"SELECT *, {', '.join(inner)} FROM {source}"
    step2 = "SELECT *, " + ", ".join(f"({a}) AS act_{v}" for v, a, _ in outer) + f" FROM ({step1})"
    cols = []
    for v, _, pens in outer:
        cols += [f"{p} AS p_{v}_{c}" for c, p in pens.items()]
    step3 = f"SELECT *, {', '.join(cols)} FROM ({step2})"
    cols = []
    for v, _, pens in outer:
        cols.append(f"CASE WHEN act_{v} > 0 THEN 1 - ({' + '.join(f'p_{v}_{c}' for c in CIDS)}) END AS score_{v}")
        for layer in layers:
            members = " + ".join(f"p_{v}_{c}" for c in CIDS if LAYER_OF[c] == layer)
            cols.append(f"CASE WHEN act_{v} > 0 THEN {members} END AS contrib_{v}_{layer}")
    return f"SELECT *, {', '.join(cols)} FROM ({step3})"


cte("so", scored_sql(WEIGHTS), "vio_o")

LAYERS = ("coverage", "timing", "quality", "value")


def long_sql(view: str, source: str = "so", keep: str = "*") -> str:
    parts = []
    for i, c in enumerate(CIDS):
        s = "s_" + c[2:]
        parts.append(
            f"SELECT {keep}, {i} AS position, '{c}' AS constraint_id, '{LAYER_OF[c]}' AS layer, {vcol(c)} AS v, {s} AS s,"
            f" x_{c[2:]} AS x, p_{view}_{c} AS p, score_{view} AS score FROM {source}"
        )
    return " UNION ALL ".join(parts)


def backlog_sql(
    keys: str, view: str = "A", gamma: float = 20, source: str = "so", volume: str = "count(*)", baseline: str | None = None, where: str = "TRUE"
) -> str:
    """The ranked backlog written out; ``keys`` is a comma separated list."""
    base = baseline or f"(SELECT avg(score_{view}) FROM {source} WHERE score_{view} IS NOT NULL AND {where})"
    groups = (
        f"SELECT {keys}, count(*) AS n_cases, avg(score_{view}) AS mean_score, stddev_samp(score_{view}) AS sd,"
        f" CAST({volume} AS DOUBLE) AS volume FROM {source} WHERE score_{view} IS NOT NULL AND {where} GROUP BY {keys}"
    )
    gaps = f"SELECT *, {base} AS global_mean, greatest({base} - mean_score, 0.0) AS gap, n_cases / (n_cases + {float(gamma)}) AS shrink FROM ({groups})"
    cols = (
        f"SELECT {keys}, n_cases, mean_score, volume, global_mean, gap, volume * gap AS PI,"
        " global_mean - shrink * (global_mean - mean_score) AS stable_mean, shrink * gap AS stable_gap,"
        " volume * shrink * gap AS stable_PI,"
        f" volume * greatest(gap - 1.96 * coalesce(sd, 0) / sqrt(n_cases), 0.0) AS PI_lower FROM ({gaps})"
    )
    return f"SELECT *, row_number() OVER (ORDER BY stable_PI DESC, n_cases DESC, {keys}) AS rank FROM ({cols})"


BACKLOG_DOUBLES = "mean_score volume global_mean gap PI stable_mean stable_gap stable_PI PI_lower"


# --------------------------------------------------------------------------- dirty variant of log w
def log_wd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log w with planted faults.

    Sentinel stamps, midnight truncation, missing labels, a renamed label, blank
    resources, exact copies and copies that differ only in their value.
    """
    w = log_w(spark, sf_dir)
    n = F.col("seq")
    ts = (
        F.when(n % 997 == 0, F.lit("1900-01-01 00:00:00").cast("timestamp_ntz"))
        .when(n % 499 == 0, F.lit(None).cast("timestamp_ntz"))
        .when((F.col("activity") == "click") & (n % 4 == 0), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz"))
        .otherwise(F.col("ts"))
    )
    late = (F.col("activity") == "view") & (F.col("ts") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    label = F.when(n % 53 == 0, F.lit(None).cast("string")).when(late, "view page").otherwise(F.col("activity"))
    who = F.when(n % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("u"), (n % 7).cast("string")))
    base = w.select("case_id", label.alias("activity"), ts.alias("ts"), "seq", "value", "k", who.alias("resource"))
    exact = base.where(n % 20 == 0).withColumn("seq", n + 1_000_000_000_000)
    close = base.where(n % 33 == 0).withColumn("seq", n + 2_000_000_000_000).withColumn("value", F.col("value") + 1)
    return base.unionByName(exact).unionByName(close)


cte(
    "wd0",
    "SELECT case_id, CASE WHEN seq % 53 = 0 THEN NULL WHEN activity = 'view' AND ts >= TIMESTAMP '2024-01-20' THEN 'view page'"
    " ELSE activity END AS activity, CASE WHEN seq % 997 = 0 THEN TIMESTAMP '1900-01-01' WHEN seq % 499 = 0 THEN NULL"
    " WHEN activity = 'click' AND seq % 4 = 0 THEN date_trunc('day', ts) ELSE ts END AS ts, seq, value, k,"
    " CASE WHEN seq % 5 = 0 THEN ' ' ELSE 'u' || (seq % 7) END AS resource FROM w",
    "w",
)
cte(
    "wd",
    "SELECT * FROM wd0 UNION ALL SELECT * REPLACE (seq + 1000000000000 AS seq) FROM wd0 WHERE seq % 20 = 0"
    " UNION ALL SELECT * REPLACE (seq + 2000000000000 AS seq, value + 1 AS value) FROM wd0 WHERE seq % 33 = 0",
    "wd0",
)


# --------------------------------------------------------------------------- text form of log w
def text_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log w as a raw file would carry it: every column text, with a lifecycle column."""
    w = log_w(spark, sf_dir)
    return w.select(
        F.col("case_id").cast("string").alias("user"),
        F.col("activity").alias("event"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"),
        F.col("seq").cast("string").alias("event_id"),
        F.when(F.col("seq") % 10 == 0, F.lit("n/a")).when(F.col("seq") % 10 == 1, F.lit("")).otherwise(
            F.concat(F.lit("-"), F.round(F.col("value") * 100).cast("bigint").cast("string"))
        ).alias("cents"),
        F.when(F.col("seq") % 3 == 0, "start").otherwise("COMPLETE").alias("lifecycle"),
        F.when(F.col("seq") % 7 != 0, F.concat(F.lit("k"), F.col("k").cast("string"))).alias("kind"),
    )


cte(
    "tw",
    "SELECT CAST(case_id AS VARCHAR) AS \"user\", activity AS event, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS time,"
    " CAST(seq AS VARCHAR) AS event_id, CASE WHEN seq % 10 = 0 THEN 'n/a' WHEN seq % 10 = 1 THEN ''"
    " ELSE '-' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS cents,"
    " CASE WHEN seq % 3 = 0 THEN 'start' ELSE 'COMPLETE' END AS lifecycle,"
    " CASE WHEN seq % 7 <> 0 THEN 'k' || k END AS kind FROM w",
    "w",
)
