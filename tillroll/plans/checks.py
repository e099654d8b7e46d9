"""Registry: quality checks, contracts, expectations, screening, model tests, freshness."""

from __future__ import annotations

import datetime as dt
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import clean as C
from tillroll.operators import contracts as K
from tillroll.operators import expectations as E
from tillroll.operators import marts as M
from tillroll.operators import model_tests as MT
from tillroll.operators import quality as Q
from tillroll.operators import star as S
from tillroll.plans import oracle as O
from tillroll.plans.catalog import DATE_WINDOW, NOW, materialize, query, raw, sql_ts
from tillroll.plans.gold import DIM_DATE_CTE, _product_sql, _segments_sql
from tillroll.plans.ingest import clean_table, landing, landing_table
from tillroll.session import scratch_path
from tillroll.sources.raw import read_star_tables

# --- fixed parameters of the registered checks; the row window comes from the batch -------
MIN_DATE = dt.datetime.combine(DATE_WINDOW[0], dt.time())
MAX_DATE = dt.datetime.combine(DATE_WINDOW[1], dt.time())
WINDOW = dict(min_date=MIN_DATE, max_date=MAX_DATE, now=NOW)


def _raw_fact(raw_df: DataFrame) -> DataFrame:
    """The raw batch in the fact layout (no cleaning): the failing input for the suite."""
    std = C.standardize_columns(raw_df)
    return S.fact_transactions(C.add_total_price(C.flag_guest_customers(std)))


def _scan_sql(tx: str, expected_rows: str, lacking: tuple[str, ...] = ()) -> str:
    """The scanned checks; ``expected_rows`` is a query of the row count, ``lacking`` the absent columns."""
    ts = "%Y-%m-%d %H:%M:%S"
    have = [c for c in Q.NON_NULL_COLUMNS if c not in lacking]
    nulls = " + ".join(f"null_{c}" for c in have)
    named = ", ".join(f"CASE WHEN null_{c} > 0 THEN '{c}=' || null_{c} END" for c in have)
    gone = ", ".join(c for c in Q.NON_NULL_COLUMNS if c in lacking)
    detail = f"'the table lacks {gone}'" if gone else f"CASE WHEN {nulls} > 0 THEN concat_ws(', ', {named}) ELSE '' END"
    checks = {
        "row_count_in_range": ([], "n = expected", "n", "expected || ' to ' || expected || ' rows'", "''"),
        "no_nulls_in_required_columns": (
            [],
            f"{nulls} = 0 AND {not lacking}",
            f"({nulls}) || ' nulls in {len(have)} columns'",
            f"'no nulls in {', '.join(Q.NON_NULL_COLUMNS)}'",
            detail,
        ),
        "no_non_positive_quantity_or_price": (
            ["quantity", "unit_price"],
            "bad_quantity = 0 AND bad_price = 0",
            "'quantity: ' || bad_quantity || ', unit_price: ' || bad_price",
            "'no row with quantity or unit_price at or under 0'",
            "''",
        ),
        "revenue_finite_and_positive": (
            ["total_price"],
            "bad_revenue = 0 AND coalesce(revenue, 0) > 0",
            "CASE WHEN bad_revenue > 0 THEN bad_revenue || ' rows without a finite total_price' "
            "ELSE coalesce(CAST(revenue AS VARCHAR), 'no rows') END",
            "'a total above 0, of finite lines'",
            "''",
        ),
        "total_price_matches_quantity_times_price": (
            ["total_price", "quantity", "unit_price"],
            "mismatches = 0",
            "mismatches || ' rows off, the worst by ' || max_off",
            "'total_price within 0.01 of quantity * unit_price'",
            "''",
        ),
        "invoice_date_within_expected_window": (
            ["invoice_date"],
            "early + late + future + undated = 0",
            f"coalesce(strftime(first, '{ts}'), 'none') || ' to ' || coalesce(strftime(last, '{ts}'), 'none') || ', too early: ' "
            "|| early || ', too late: ' || late || ', in future: ' || future || ', without date: ' || undated",
            f"'dates from {MIN_DATE.date()} to {MAX_DATE.date()}, none later than now'",
            "''",
        ),
    }
    rows = []
    for name, (needs, passed, actual, expected, note) in checks.items():
        absent = [c for c in needs if c in lacking]
        if absent:
            passed, actual, note = "false", "'not checked'", f"'the table lacks {', '.join(absent)}'"
        order = Q.CHECK_NAMES.index(name) + 1
        rows.append(
            f"SELECT {order} AS check_order, '{name}' AS name, {passed} AS passed, CAST({actual} AS VARCHAR) AS actual, "
            f"{expected} AS expected, {note} AS detail FROM m"
        )
    aggregates = {
        "n": (None, "count(*)"),
        **{f"null_{c}": (c, f"count_if({c} IS NULL)") for c in have},
        "bad_quantity": ("quantity", "count_if(quantity <= 0)"),
        "bad_price": ("unit_price", "count_if(unit_price <= 0)"),
        "revenue": ("total_price", "CAST(sum(total_price) AS DECIMAL(24,2))"),
        "bad_revenue": ("total_price", "count_if(total_price IS NULL)"),
        "early": (None, f"count_if(invoice_date < {sql_ts(MIN_DATE)})"),
        "late": (None, f"count_if(invoice_date > {sql_ts(MAX_DATE)})"),
        "future": (None, f"count_if(invoice_date > {sql_ts(NOW)})"),
        "undated": (None, "count_if(invoice_date IS NULL)"),
        "first": (None, "min(invoice_date)"),
        "last": (None, "max(invoice_date)"),
    }
    if not {"total_price", "quantity", "unit_price"} & set(lacking):
        off = "abs(total_price - quantity * unit_price)"
        aggregates["mismatches"] = (None, f"count_if({off} > 0.01)")
        aggregates["max_off"] = (None, f"CAST(coalesce(max({off}), 0) AS DECIMAL(20,4))")
    listed = ", ".join(f"{sql} AS {name}" for name, (column, sql) in aggregates.items() if column not in lacking)
    return f"m AS (SELECT {listed}, ({expected_rows}) AS expected FROM {tx}),\nscan_rows AS (" + "\nUNION ALL ".join(rows) + ")"


def _fk_sql(order: int, name: str, tx: str, key: str, dim: str, as_text: bool) -> str:
    k = f"CAST({key} AS VARCHAR)" if as_text else key
    return f"""
keys{order} AS (SELECT {k} AS k, count(*) AS n FROM {tx} WHERE {key} IS NOT NULL GROUP BY 1),
dim{order} AS (SELECT DISTINCT {k} AS k FROM {dim} WHERE {key} IS NOT NULL),
gone{order} AS (SELECT * FROM keys{order} ANTI JOIN dim{order} USING (k)),
fk{order} AS (
    SELECT {order} AS check_order, '{name}' AS name, count(*) = 0 AS passed,
           count(*) || ' unknown of ' || (SELECT count(*) FROM keys{order}) || ' keys, on ' || coalesce(sum(n), 0)
             || ' rows; the dimension has ' || (SELECT count(*) FROM dim{order}) AS actual,
           'every {key} of the facts in the dimension' AS expected,
           CASE WHEN count(*) = 0 THEN '' ELSE 'unknown: ' || array_to_string(list_sort(list(k))[1:{Q.ORPHAN_SAMPLE}], ', ') END AS detail
    FROM gone{order})"""


def _report_sql(tx_cte: str, expected_rows: str, lacking: tuple[str, ...] = ()) -> str:
    return (
        O.with_ctes(
            O.STANDARDIZED,
            O.CLEAN,
            tx_cte,
            "cust AS (SELECT DISTINCT CustomerID AS customer_id FROM clean WHERE CustomerID IS NOT NULL)",
            "prod AS (SELECT DISTINCT StockCode AS stock_code FROM clean)",
            _scan_sql("tx", expected_rows, lacking),
            _fk_sql(4, "fk_transactions_customer_id", "tx", "customer_id", "cust", False),
            _fk_sql(5, "fk_transactions_stock_code", "tx", "stock_code", "prod", True),
        )
        + "SELECT * FROM scan_rows UNION ALL SELECT * FROM fk4 UNION ALL SELECT * FROM fk5"
    )


CLEAN_TX = """tx AS (SELECT InvoiceNo AS invoice_no, StockCode AS stock_code, CustomerID AS customer_id, Quantity AS quantity,
    UnitPrice AS unit_price, TotalPrice AS total_price, InvoiceDate AS invoice_date, Country AS country, is_guest FROM clean)"""
RAW_TX = """tx AS (SELECT InvoiceNo AS invoice_no, StockCode AS stock_code, CustomerID AS customer_id, Quantity AS quantity,
    UnitPrice AS unit_price, CAST(round(Quantity * UnitPrice, 2) AS DECIMAL(14,2)) AS total_price,
    InvoiceDate AS invoice_date, Country AS country, CustomerID IS NULL AS is_guest FROM std)"""


CLEAN_ROWS = "SELECT count(*) FROM clean"
LACKING = ("unit_price", "total_price")


def _window(batch: DataFrame) -> dict:
    """The checks' parameters for a stored batch: exactly its rows."""
    n = batch.count()
    return {**WINDOW, "min_rows": n, "max_rows": n}


def _loaded(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], dict]:
    """The star loaded from the cleaned batch and read back, and the window the batch sets."""
    root = scratch_path(spark, "star")
    cleaned = clean_table(spark, sf_dir)
    S.load_star(cleaned, root)
    return list(read_star_tables(spark, root)), _window(cleaned)


@query("quality_report", _report_sql(CLEAN_TX, CLEAN_ROWS), "Q1-Q9,A10,A11,A12,J6,J7,J8,T3,U1")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight checks over the loaded star (passing)."""
    tables, window = _loaded(spark, sf_dir)
    return Q.run_all_checks(*tables, **window)


@query("quality_report_absent_column", _report_sql(CLEAN_TX, CLEAN_ROWS, LACKING), "Q2,Q3,Q6,Q7,Q9")
def quality_report_absent_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same suite where the facts lack two columns: failed rows, and no check missing."""
    (tx, customers, products), window = _loaded(spark, sf_dir)
    return Q.run_all_checks(tx.drop(*LACKING), customers, products, **window)


@query("quality_report_raw", _report_sql(RAW_TX, "SELECT count(*) FROM std"), "Q1-Q9 (failing input)")
def quality_report_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same suite over the uncleaned batch against the clean star's dimensions: Q3 and
    the product foreign key fail, and every failure is reported in one run."""
    batch = materialize(raw(spark, sf_dir), "raw")
    cleaned = materialize(C.clean_data(batch).select("StockCode", "Description", "CustomerID", "Country"), "clean-keys")
    return Q.run_all_checks(_raw_fact(batch), S.star_dim_customers(cleaned), S.star_dim_products(cleaned), **_window(batch))


def drifted_batch(raw_df: DataFrame) -> DataFrame:
    """A batch with every kind of drift, derived from the whole raw batch: Country removed,
    a new column, Quantity retyped as text, prices missing on zero-quantity lines, and an
    all-null customer column of the wrong type (exempt: it carries no type evidence)."""
    return (
        raw_df.withColumn("UnitPrice", F.when(F.col("Quantity") == 0, F.lit(None)).otherwise(F.col("UnitPrice")))
        .withColumn("Quantity", F.col("Quantity").cast("string"))
        .withColumn("CustomerID", F.lit(None).cast("int"))
        .drop("Country")
        .withColumn("SalesChannel", F.lit("web"))
    )


DRIFT_SQL = O.with_ctes() + """, n AS (SELECT count_if(Quantity = 0) AS zero FROM retail_raw)
SELECT 'Quantity' AS "column", 'type_change' AS kind, 'breaking' AS severity, 'integer declared, string found' AS detail
UNION ALL SELECT 'UnitPrice', 'unexpected_nulls', 'breaking', zero || ' nulls in a required column' FROM n WHERE zero > 0
UNION ALL SELECT 'Country', 'missing_column', 'breaking', 'the batch lacks it'
UNION ALL SELECT 'SalesChannel', 'new_column', 'additive', 'the contract does not know it'"""


@query("contract_drift", DRIFT_SQL, "C1-C6,U2")
def contract_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.detect_drift(drifted_batch(raw(spark, sf_dir)))


@query("contract_enforce", DRIFT_SQL.replace("SELECT 'Quantity' AS", "SELECT true AS raised, 'Quantity' AS").replace("UNION ALL SELECT '", "UNION ALL SELECT true, '"), "C7")
def contract_enforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enforcing the contract on the drifted batch: whether it raised, and the findings the error
    carries; the undrifted batch must pass."""
    batch = raw(spark, sf_dir)
    if K.enforce_contract(batch):
        raise RuntimeError("the undrifted batch has findings")
    try:
        found, raised = K.enforce_contract(drifted_batch(batch)), False
    except K.SchemaDriftError as error:
        found, raised = error.findings, True
    rows = [(raised, f["column"], f["kind"], f["severity"], f["detail"]) for f in found]
    return spark.createDataFrame(rows, "raised boolean, column string, kind string, severity string, detail string")


_INFER_COLS = [
    ("InvoiceNo", "string"),
    ("StockCode", "string"),
    ("Description", "string"),
    ("Quantity", "integer"),
    ("InvoiceDate", "datetime"),
    ("UnitPrice", "float"),
    ("CustomerID", "string"),
    ("Country", "string"),
]
INFER_SQL = O.with_ctes() + "\nUNION ALL\n".join(
    f"SELECT {i} AS ordinal, '{c}' AS \"column\", '{k}' AS type_kind, count_if({c} IS NULL) > 0 AS nullable FROM retail_raw"
    for i, (c, k) in enumerate(_INFER_COLS)
)


@query("contract_infer", INFER_SQL, "C8")
def contract_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.infer_frame(raw(spark, sf_dir))


CONTRACT_SQL = O.with_ctes() + "\nUNION ALL\n".join(
    f"SELECT 'inferred' AS contract, 3::BIGINT AS version, {i} AS ordinal, '{c}' AS \"column\", '{k}' AS type_kind, "
    f"count_if({c} IS NULL) > 0 AS nullable, {c in ('Country', 'InvoiceNo')} AS listed FROM retail_raw"
    for i, (c, k) in enumerate(_INFER_COLS)
)


@query("contract_frame", CONTRACT_SQL, "S8,K7,C8,C9")
def contract_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract inferred from the batch, written as a document and read back as rows; ``listed``
    marks the columns that a filtered column list names."""
    inferred = K.infer_contract(raw(spark, sf_dir), "inferred", 3)
    path = scratch_path(spark, "contract")
    with tempfile.TemporaryDirectory() as folder:  # the document is driver metadata of a few lines
        written = K.write_contract(inferred, f"{folder}/c.json")
        if K.read_contract(written) != inferred:
            raise RuntimeError("the contract changed on its way through the document")
        spark.createDataFrame([(written.read_text(),)], "value string").coalesce(1).write.text(path)
    listed = K.declared_columns(inferred, only=["Country", "InvoiceNo"])
    return K.contract_frame(spark, path).withColumn("listed", F.col("column").isin(listed))


def _suite_sql() -> str:
    parts = [
        "SELECT 0 AS expectation_order, 'expect_table_columns_to_match_set' AS expectation, CAST(NULL AS VARCHAR) AS "
        '"column", true AS success, CAST(0 AS DOUBLE) AS observed',
        "SELECT 1, 'expect_table_row_count_to_be_between', NULL, count(*) >= 1, CAST(count(*) AS DOUBLE) FROM retail_raw",
    ]
    for i, c in enumerate(E.NOT_NULL_COLUMNS, start=2):
        parts.append(
            f"SELECT {i}, 'expect_column_values_to_not_be_null', '{c}', count_if({c} IS NULL) = 0, "
            f"CAST(count_if({c} IS NULL) AS DOUBLE) FROM retail_raw"
        )
    frac = "round(CAST(count(CustomerID) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6)"
    parts.append(
        f"SELECT 8, 'expect_column_values_to_not_be_null', 'CustomerID', count(*) = 0 OR {frac} >= 0.6, "
        f"CASE WHEN count(*) > 0 THEN {frac} END FROM retail_raw"
    )
    qbad = "count_if(Quantity IS NOT NULL AND NOT (Quantity >= -100000 AND Quantity <= 100000))"
    pbad = "count_if(UnitPrice IS NOT NULL AND NOT (UnitPrice >= -20000 AND UnitPrice <= 50000))"
    parts.append(f"SELECT 9, 'expect_column_values_to_be_between', 'Quantity', {qbad} = 0, CAST({qbad} AS DOUBLE) FROM retail_raw")
    parts.append(f"SELECT 10, 'expect_column_values_to_be_between', 'UnitPrice', {pbad} = 0, CAST({pbad} AS DOUBLE) FROM retail_raw")
    nn = "count(UnitPrice)"
    pfrac = f"round(CAST(count_if(UnitPrice >= 0) AS DOUBLE) / CAST({nn} AS DOUBLE), 6)"
    parts.append(
        f"SELECT 11, 'expect_column_values_to_be_between', 'UnitPrice', {nn} = 0 OR {pfrac} >= 0.99, "
        f"CASE WHEN {nn} > 0 THEN {pfrac} END FROM retail_raw"
    )
    parts.append(
        "SELECT 12, 'expect_column_unique_value_count_to_be_between', 'Country', "
        "count(DISTINCT Country) BETWEEN 1 AND 80, CAST(count(DISTINCT Country) AS DOUBLE) FROM retail_raw"
    )
    return O.with_ctes() + "\nUNION ALL\n".join(parts)


@query("expectation_suite", _suite_sql(), "E1-E14,A13,A14,U3")
def expectation_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.evaluate_suite(raw(spark, sf_dir))


SCREEN_SQL = O.with_ctes() + """SELECT count(*) AS rows, 0 AS breaking_drift, 0 AS additive_drift,
       13 AS expectations_run, 0 AS expectations_failed, 'success' AS outcome FROM retail_raw"""


@query("screen_batch", SCREEN_SQL, "G1")
def screen_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screen the raw batch (enforcing); the stage's event."""
    from tillroll.streaming.events import PIPELINE, RunLog, run_stages

    log = RunLog(spark, scratch_path(spark, "events"))
    run_stages([s for s in PIPELINE if s.name == "screen"], {"raw": raw(spark, sf_dir)}, log)
    names = ("rows", "breaking_drift", "additive_drift", "expectations_run", "expectations_failed")
    return log.read().filter("outcome <> 'finding'").select(*[F.col(f"metrics.{n}").alias(n) for n in names], "outcome")


def _model_sql() -> str:
    fct = """
fct AS (
    SELECT md5(concat_ws('-', coalesce(CAST(invoice_no AS VARCHAR), '<null>'),
                coalesce(CAST(product_key AS VARCHAR), '<null>'),
                coalesce(strftime(invoiced_at, '%Y-%m-%d %H:%M:%S.%f'), '<null>'),
                coalesce(CAST(unit_price AS VARCHAR), '<null>'),
                coalesce(CAST(quantity AS VARCHAR), '<null>'))) AS sales_key, *
    FROM stg
),
dim_customer AS (SELECT * FROM segmented),
dim_product AS (
    SELECT f.product_key, coalesce(d.product_description, 'UNKNOWN PRODUCT') AS product_description,
           f.avg_selling_price FROM prod_facts f LEFT JOIN prod_desc d ON f.product_key = d.product_key
)"""
    tables = {"landing": "landing", "fct_sales": "fct", "dim_customer": "dim_customer", "dim_product": "dim_product", "dim_date": "dim_date"}
    exprs = {
        "line_revenue_positive": "line_revenue > 0",
        "revenue_matches_quantity_times_price": "abs(line_revenue - quantity * unit_price) < 0.01",
    }
    parts = []
    for i, t in enumerate(MT.MODEL_TESTS):
        tbl = tables[t.model]
        col = f"'{t.column}'" if t.column else "CAST(NULL AS VARCHAR)"
        head = f"SELECT {i} AS test_order, '{t.name}' AS test_name, '{t.model}' AS model, {col} AS column_name, '{t.kind}' AS kind, "
        c = t.column
        if t.kind == "not_null":
            body = f"count_if({c} IS NULL)"
            src = tbl
        elif t.kind == "unique":
            body = "coalesce(sum(CASE WHEN _c > 1 THEN _c END), 0)"
            src = f"(SELECT {c}, count(*) AS _c FROM {tbl} WHERE {c} IS NOT NULL GROUP BY {c})"
        elif t.kind == "relationships":
            target, field = t.args
            body = "count(*)"
            src = f"(SELECT {c} FROM {tbl} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {field} FROM {tables[target]} WHERE {field} IS NOT NULL))"
        elif t.kind == "accepted_range":
            lo, hi, inc = t.args
            conds = []
            if lo is not None:
                conds.append(f"{c} {'>=' if inc else '>'} {lo}")
            if hi is not None:
                conds.append(f"{c} {'<=' if inc else '<'} {hi}")
            body = f"count_if({c} IS NOT NULL AND NOT ({' AND '.join(conds)}))"
            src = tbl
        elif t.kind == "accepted_values":
            vals = ", ".join(f"'{v}'" for v in t.args)
            body = f"count_if({c} IS NOT NULL AND {c} NOT IN ({vals}))"
            src = tbl
        else:
            body = f"count_if(NOT coalesce({exprs[t.args[0]]}, false))"
            src = tbl
        parts.append(f"{head}CAST({body} AS BIGINT) AS failures FROM {src}")
    union = "\nUNION ALL\n".join(parts)
    return (
        O.stg_chain(_segments_sql("stg"), _product_sql("stg"), DIM_DATE_CTE, fct)
        + f"SELECT *, failures = 0 AS passed FROM (\n{union}\n)"
    )


@query("model_tests", _model_sql(), "M1,M3-M8,J9,K6")
def model_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build the marts as tables, read them back, and run the 36 declarative tests. The landing
    table is written once, for its own tests and for the staging that all marts read."""
    landed = landing_table(spark, sf_dir)
    paths = M.build_warehouse(M.stg_transactions(landed), scratch_path(spark, "marts"))
    models = {name: spark.read.parquet(path) for name, path in paths.items()}
    return MT.run_model_tests({**models, "landing": landed})


FRESHNESS_SQL = O.with_ctes(O.STANDARDIZED, O.CLEAN, O.LANDING) + f"""SELECT max(loaded_at) AS max_loaded_at,
       {sql_ts(NOW)} AS checked_at,
       round((epoch_us({sql_ts(NOW)}) - epoch_us(max(loaded_at))) / 3600000000.0, 6) AS age_hours,
       CASE WHEN max(loaded_at) IS NULL THEN 'error'
            WHEN (epoch_us({sql_ts(NOW)}) - epoch_us(max(loaded_at))) / 3600000000.0 > 36 THEN 'error'
            WHEN (epoch_us({sql_ts(NOW)}) - epoch_us(max(loaded_at))) / 3600000000.0 > 12 THEN 'warn'
            ELSE 'pass' END AS status
FROM landing"""


@query("source_freshness", FRESHNESS_SQL, "M2")
def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MT.source_freshness(landing(spark, sf_dir), NOW)
