"""DuckDB SQL for every SQL-expressible query in ``catalog.QUERIES``.

Tables are the pre-registered views (region, nation, customer, ..., events).
Column names and roundings match the Spark side exactly. Per-column reports
are written as UNION ALL blocks generated from a column list.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

EV_K = """SELECT event_id, ts, user_id, event_type, value,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"""

EV_GAPS = f"""SELECT event_id, ts, user_id,
       CASE WHEN event_id % 5 <> 1 THEN event_type END AS event_type,
       CASE WHEN event_id % 7 <> 0 THEN value END AS value,
       CASE WHEN event_id % 11 <> 3 THEN k END AS k
FROM ({EV_K})"""

# (name, spark type name) of the frames used below
EV_GAPS_COLS = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
                ("value", "double"), ("k", "bigint")]
ORDERS_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]
CUSTOMER_COLS = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")]
DOCUMENTS_COLS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")]
LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax"]
LABELS_COLS = ["doc_id", "quality", "toxic"]

INTEGRAL = {"bigint", "int", "smallint", "tinyint"}
NUMERIC = INTEGRAL | {"double", "float"}
TEMPORAL = {"timestamp", "timestamp_ntz", "date"}


def _ident(c: str) -> str:
    return '"' + c + '"'


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_summary_stats(src: str, cols: list[str]) -> str:
    parts = [f"SELECT {_q(c)} AS \"column\", count(*) AS n_rows, count(*) - count({_ident(c)}) AS n_missing FROM src"
             for c in cols]
    return f"WITH src AS ({src})\n" + "\nUNION ALL ".join(parts)


def sql_column_summary(src: str, cols: list[tuple[str, str]], order: str, sep: str = " | ") -> str:
    return f"WITH src AS ({src})\n" + sql_column_summary_body(cols, order, sep)


def sql_column_summary_body(cols: list[tuple[str, str]], order: str, sep: str = " | ") -> str:
    """Column summary over a relation named ``src``."""
    parts = []
    for c, t in cols:
        ci = _ident(c)
        parts.append(f"""SELECT {_q(c)} AS "column", {_q(t)} AS dtype,
  (SELECT count(*) - count({ci}) FROM src) AS n_missing,
  (SELECT count(DISTINCT {ci}) FROM src) AS n_unique,
  coalesce((SELECT string_agg(v, {_q(sep)} ORDER BY f, v) FROM (
      SELECT CAST({ci} AS VARCHAR) AS v, min({order}) AS f FROM src WHERE {ci} IS NOT NULL
      GROUP BY 1 ORDER BY f, v LIMIT 5)), '') AS sample_values""")
    return "\nUNION ALL ".join(parts)


def sql_field_roles(src: str, cols: list[tuple[str, str]], digits: int = 6) -> str:
    parts = []
    for c, t in cols:
        ci = _ident(c)
        parts.append(
            f"SELECT {_q(c)} AS \"column\", {_q(t)} AS dtype, {str(t in INTEGRAL).lower()} AS is_int, "
            f"{str(t in NUMERIC).lower()} AS is_num, {str(t in TEMPORAL).lower()} AS is_time, "
            f"count(DISTINCT {ci}) AS nunique, count({ci}) AS nonnull, count(*) AS n FROM src")
    inner = "\nUNION ALL ".join(parts)
    return f"""WITH src AS ({src}), s AS ({inner})
SELECT "column", dtype, nunique,
  round(CASE WHEN n > 0 THEN CAST(n - nonnull AS DOUBLE) / n END, {digits}) AS pct_null,
  CASE WHEN regexp_matches(lower("column"), '(id$|_id$|^id$|identifier)')
            OR (is_int AND nunique > 50 AND nunique = nonnull) THEN 'id'
       WHEN is_num THEN 'numeric'
       WHEN is_time OR regexp_matches(lower("column"), '(date|time|timestamp|year)') THEN 'datetime'
       WHEN nunique <= 50 THEN 'categorical'
       ELSE 'text' END AS role,
  lower("column") IN ('target', 'label', 'outcome', 'y', 'class', 'status', 'fraud', 'is_fraud', 'churn')
    AS likely_target
FROM s"""


def _register():
    O = ORACLE
    gaps_names = [c for c, _ in EV_GAPS_COLS]

    impute = f"""WITH ev AS ({EV_GAPS})
SELECT event_id, ts, user_id, coalesce(event_type, 'missing') AS event_type,
       coalesce(value, (SELECT median(value) FROM ev)) AS value,
       coalesce(CAST(k AS DOUBLE), (SELECT CAST(median(k) AS DOUBLE) FROM ev)) AS k
FROM ev"""
    O["clean_table"] = impute
    O["impute_median"] = impute
    O["text_fill"] = f"""WITH ev AS ({EV_GAPS})
SELECT event_id, ts, user_id, coalesce(event_type, 'missing') AS event_type, value, k FROM ev"""
    O["drop_missing"] = f"""WITH ev AS ({EV_GAPS})
SELECT * FROM ev WHERE event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL
  AND event_type IS NOT NULL AND value IS NOT NULL AND k IS NOT NULL"""

    def sigma_chain(base: str, cols: list[str], start: str = "b0") -> tuple[str, str]:
        ctes, prev = [], start
        for i, c in enumerate(cols, 1):
            cur = f"s{i}"
            ctes.append(f"""{cur} AS (SELECT * FROM {prev} WHERE
  {c} > (SELECT avg({c}) - 3 * stddev_samp({c}) FROM {prev}) AND
  {c} < (SELECT avg({c}) + 3 * stddev_samp({c}) FROM {prev}))""")
            prev = cur
        return ",\n".join(ctes), prev

    chain, last = sigma_chain("b0", ["event_id", "user_id", "value", "k"])
    O["three_sigma"] = f"WITH b0 AS ({EV_K}),\n{chain}\nSELECT * FROM {last}"

    ctes = []
    for c in ["event_id", "user_id", "value", "k"]:
        ctes.append(f"{c} > (SELECT avg({c}) - 3 * stddev_samp({c}) FROM b0) AND "
                    f"{c} < (SELECT avg({c}) + 3 * stddev_samp({c}) FROM b0)")
    O["three_sigma_single_pass"] = f"WITH b0 AS ({EV_K})\nSELECT * FROM b0 WHERE " + "\n  AND ".join(ctes)

    O["dedupe_full_rows"] = f"""SELECT DISTINCT user_id, event_type, k FROM ({EV_K})"""
    O["three_sigma_nan"] = """WITH b AS (SELECT event_id, CASE WHEN event_id % 13 <> 5 THEN value END AS value FROM events)
SELECT * FROM b WHERE value > (SELECT avg(value) - 3 * stddev_samp(value) FROM b)
  AND value < (SELECT avg(value) + 3 * stddev_samp(value) FROM b)"""
    O["fill_strategy"] = f"""WITH g AS ({EV_GAPS}),
m AS (SELECT event_type FROM g WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT event_id, coalesce(event_type, (SELECT event_type FROM m)) AS event_type,
       round(coalesce(value, (SELECT avg(value) FROM g)), 6) AS value,
       round(coalesce(CAST(k AS DOUBLE), (SELECT avg(k) FROM g)), 6) AS k FROM g"""
    O["fill_strategy_ffill"] = f"""SELECT event_id, coalesce(event_type, 'none') AS event_type,
       last_value(value IGNORE NULLS) OVER w AS value,
       CAST(last_value(k IGNORE NULLS) OVER w AS DOUBLE) AS k FROM ({EV_GAPS})
WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
    O["rename_target"] = "SELECT doc_id, quality, toxic AS target FROM labels"
    O["drop_target"] = "SELECT doc_id, quality FROM labels"
    O["csv_documents_roundtrip"] = O["csv_documents_default"] = "SELECT * FROM documents"
    O["csv_keyed_long"] = """SELECT p_partkey, 'p_size' AS field, CAST(p_size AS DOUBLE) AS value FROM part WHERE p_size <> 0
UNION ALL SELECT p_partkey, 'p_retailprice', round(p_retailprice, 6) FROM part WHERE p_retailprice <> 0"""
    O["audit_roundtrip"] = O["stream_audit"] = """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts,
       event_type AS action, user_id FROM events"""
    O["logistic_text_label"] = O["model_roundtrip"] = O["stream_score"] = """SELECT doc_id,
       CASE WHEN n_chars BETWEEN 1000 AND 9000 THEN 'near' WHEN n_chars >= 3000 THEN 'long' ELSE 'short' END AS size FROM documents"""
    O["stream_score_gaps"] = """SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN NULL WHEN n_chars BETWEEN 1000 AND 9000 THEN 'near'
       WHEN n_chars >= 3000 THEN 'long' ELSE 'short' END AS size FROM documents"""
    O["forest_rule"] = """SELECT doc_id, CASE WHEN n_chars NOT BETWEEN 2500 AND 3500 THEN CAST(n_chars >= 3000 AS INTEGER) END AS long,
       CASE WHEN n_chars NOT BETWEEN 2500 AND 3500 THEN n_chars >= 3000 END AS likely, true AS scored FROM documents"""
    O["predict_all_rows"] = "SELECT doc_id, doc_id % 10 = 3 AS no_score FROM documents"
    O["isolation_planted"] = "SELECT event_id, CASE WHEN event_id % 1000 = 7 THEN true END AS planted_flagged, true AS few_others FROM events"

    O["dedupe"] = """SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type"""

    def ffill(col: str, part: str = "") -> str:
        p = f"PARTITION BY {part} " if part else ""
        return (f"coalesce(last_value({col} IGNORE NULLS) OVER ({p}ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING "
                f"AND CURRENT ROW), first_value({col} IGNORE NULLS) OVER ({p}ORDER BY event_id ROWS BETWEEN "
                f"UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS {col}")

    O["fill_global"] = f"""WITH ev AS ({EV_GAPS})
SELECT event_id, ts, user_id, {ffill('event_type')}, {ffill('value')}, {ffill('k')} FROM ev"""
    O["fill_grouped"] = f"""WITH ev AS ({EV_GAPS})
SELECT event_id, ts, user_id, {ffill('event_type', 'user_id')}, {ffill('value', 'user_id')},
       {ffill('k', 'user_id')} FROM ev"""

    by_day = lambda c: ffill(c).replace("ORDER BY event_id", "ORDER BY day, event_id")
    O["fill_struct_order"] = f"""WITH ev AS (SELECT *, strftime(ts, '%Y-%m') AS day FROM ({EV_GAPS}))
SELECT event_id, day, {by_day('value')}, {by_day('k')} FROM ev"""
    O["fill_text_order"] = f"""WITH ev AS ({EV_GAPS})
SELECT printf('event/%012d', event_id) AS code, {ffill('event_type')}, {ffill('value')} FROM ev"""

    chain, last = sigma_chain("f", ["user_id", "value", "k"], start="f")
    O["clean_records"] = f"""WITH ev AS ({EV_GAPS}),
d AS (SELECT user_id, event_type, value, k, min(event_id) AS event_id FROM ev GROUP BY user_id, event_type, value, k),
f AS (SELECT user_id, {ffill('event_type')}, {ffill('value')}, {ffill('k')}, event_id FROM d),
{chain}
SELECT event_id, user_id, event_type, value, k FROM {last}"""

    O["stream_clean_stateful"] = f"""WITH ev AS ({EV_GAPS}),
d AS (SELECT user_id, event_type, value, k, min(event_id) AS event_id FROM ev GROUP BY user_id, event_type, value, k)
SELECT event_id, user_id, {ffill('event_type')}, {ffill('value')}, {ffill('k')} FROM d"""
    O["clean_records_summary"] = O["clean_records"].replace(
        "SELECT event_id, user_id, event_type, value, k FROM " + last,
        "SELECT count(*) AS rows, CAST(count(*) * 5 - count(event_id) - count(user_id) - count(event_type) "
        "- count(value) - count(k) AS BIGINT) AS total_missing FROM " + last)

    sc = ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT coalesce(nullif(stddev_pop({c}), 0), 1) "
        f"FROM lineitem), 6) AS {c}" for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    O["standard_scale"] = f"SELECT l_orderkey, l_linenumber, {sc} FROM lineitem"
    sc2 = ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM part)) / (SELECT coalesce(nullif(stddev_pop({c}), 0), 1) "
        f"FROM part), 6) AS {c}" for c in ["p_size", "p_retailprice"])
    O["standard_scale_part"] = f"SELECT p_partkey, {sc2} FROM part"
    O["trim_columns"] = "SELECT n_nationkey, n_name, n_regionkey FROM nation"

    O["summary_stats"] = sql_summary_stats(EV_GAPS, gaps_names)
    O["missing_total"] = (f"WITH ev AS ({EV_GAPS}) SELECT CAST(" +
                          " + ".join(f"count(*) - count({c})" for c in gaps_names) +
                          " AS BIGINT) AS total_missing FROM ev")
    O["column_summary"] = sql_column_summary("SELECT * FROM orders", ORDERS_COLS, "o_orderkey")
    LINEITEM_COLS = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                     ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                     ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                     ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]
    O["column_summary_lineitem"] = sql_column_summary("SELECT * FROM lineitem", LINEITEM_COLS,
                                                      "(l_orderkey, l_linenumber, l_partkey)")
    O["column_summary_documents"] = sql_column_summary("SELECT * FROM documents", DOCUMENTS_COLS, "doc_id")
    O["missing_fraction"] = f"WITH src AS ({EV_GAPS})\n" + "\nUNION ALL ".join(
        f"SELECT {_q(c)} AS \"column\", round(avg(CAST({c} IS NULL AS DOUBLE)), 6) AS missing_frac FROM src"
        for c in gaps_names)
    O["describe"] = "\nUNION ALL ".join(
        f"""SELECT {_q(c)} AS "column", count({c}) AS count, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min,
  round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50,
  round(quantile_cont({c}, 0.75), 4) AS p75, round(CAST(max({c}) AS DOUBLE), 4) AS max FROM lineitem"""
        for c in LINEITEM_NUM)
    O["describe_text"] = "\nUNION ALL ".join(
        f"""SELECT {_q(c)} AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
  arg_min(v, (-n, v)) AS top, max(n) AS freq
FROM (SELECT {c} AS v, count(*) AS n FROM customer WHERE {c} IS NOT NULL GROUP BY 1)"""
        for c in ["c_name", "c_mktsegment"])
    O["describe_text_documents"] = "\nUNION ALL ".join(
        f"""SELECT {_q(c)} AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
  arg_min(v, (-n, v)) AS top, max(n) AS freq
FROM (SELECT {c} AS v, count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY 1)"""
        for c in ["text", "lang", "source"])
    O["describe_text_nation"] = """SELECT 'n_name' AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
  arg_min(v, (-n, v)) AS top, max(n) AS freq
FROM (SELECT n_name AS v, count(*) AS n FROM nation WHERE n_name IS NOT NULL GROUP BY 1)"""
    O["field_roles"] = sql_field_roles("SELECT * FROM orders", ORDERS_COLS)
    O["inspect_roles"] = O["field_roles"]
    O["inspect_summary"] = O["column_summary"]
    O["inspect_describe_text"] = O["describe_text"]
    O["inspect_summary_documents"] = sql_column_summary("SELECT * FROM documents", DOCUMENTS_COLS, "doc_id")
    O["field_roles_customer"] = sql_field_roles("SELECT * FROM customer", CUSTOMER_COLS)
    O["field_roles_documents"] = sql_field_roles("SELECT * FROM documents", DOCUMENTS_COLS)
    O["field_roles_events"] = sql_field_roles(EV_GAPS, EV_GAPS_COLS)
    O["top_variance"] = ("SELECT \"column\", round(variance, 2) AS variance FROM (" + "\nUNION ALL ".join(
        f"SELECT {i} AS pos, {_q(c)} AS \"column\", var_samp({c}) AS variance FROM lineitem"
        for i, c in enumerate(LINEITEM_NUM)) + ") ORDER BY variance DESC, pos LIMIT 3")
    O["binary_targets"] = ("SELECT \"column\" FROM (" + "\nUNION ALL ".join(
        f"SELECT {i} AS pos, {_q(c)} AS \"column\", count(DISTINCT lower(CAST({c} AS VARCHAR))) AS n, "
        f"bool_and(lower(CAST({c} AS VARCHAR)) IN ('0', '1', 'yes', 'no', 'true', 'false')) AS ok "
        f"FROM labels WHERE {c} IS NOT NULL"
        for i, c in enumerate(LABELS_COLS)) + ") WHERE n BETWEEN 1 AND 3 AND ok")
    O["missing_pct_avg"] = (f"WITH ev AS ({EV_GAPS}) SELECT round((" +
                            " + ".join(f"avg(CAST({c} IS NULL AS DOUBLE))" for c in gaps_names) +
                            f") / {len(gaps_names)} * 100.0, 6) AS missing_pct FROM ev")

    # Before (raw gaps), after (imputed), column summary of the raw frame
    def shape(src: str, section: str) -> str:
        return (f"SELECT {_q(section)} AS section, '' AS \"column\", 'rows' AS metric, "
                f"CAST(count(*) AS VARCHAR) AS value FROM ({src})\n"
                f"UNION ALL SELECT {_q(section)}, '', 'cols', '{len(gaps_names)}'\n"
                + "\n".join(f"UNION ALL SELECT {_q(section)}, {_q(c)}, 'missing', "
                            f"CAST(count(*) - count({c}) AS VARCHAR) FROM ({src})" for c in gaps_names))
    summ = sql_column_summary_body(EV_GAPS_COLS, "event_id")
    O["quality_report"] = f"""WITH src AS ({EV_GAPS}), summ AS ({summ})
{shape(EV_GAPS, 'before')}
UNION ALL {shape(impute, 'after')}
UNION ALL SELECT 'column_summary', "column", 'dtype', dtype FROM summ
UNION ALL SELECT 'column_summary', "column", 'n_missing', CAST(n_missing AS VARCHAR) FROM summ
UNION ALL SELECT 'column_summary', "column", 'n_unique', CAST(n_unique AS VARCHAR) FROM summ
UNION ALL SELECT 'column_summary', "column", 'sample_values', sample_values FROM summ"""



EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\d[\d\s\-]{6,}\d"
AADHAR = r"\b\d{4}\s?\d{4}\s?\d{4}\b"


def sql_pii_detect(tab: str, cols: list[str], order: str, sample: int | None = 300, preview: int = 5) -> str:
    u = "\nUNION ALL ".join(f"SELECT {_q(c)} AS \"column\", {order} AS o, CAST({c} AS VARCHAR) AS v "
                            f"FROM {tab} WHERE {c} IS NOT NULL" for c in cols)
    any_match = " OR ".join(f"regexp_matches(v, {_q(p)})" for p in (EMAIL, PHONE, AADHAR))
    return f"""WITH u AS ({u}),
s AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY o) AS rn FROM u),
m AS (SELECT "column", v, min(o) AS f FROM s WHERE {f"rn <= {sample} AND " if sample else ""}({any_match}) GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY f) AS r FROM m)
SELECT "column", count(*) AS count_examples, string_agg(v, ' || ' ORDER BY r) AS examples
FROM t WHERE r <= {preview} GROUP BY 1"""


def _register_pii_and_sources():
    O = ORACLE
    O["pii_detect"] = sql_pii_detect("documents", ["text", "lang", "source"], "doc_id")
    O["pii_detect_full"] = sql_pii_detect("documents", ["text", "lang", "source"], "doc_id", sample=None)
    O["pii_detect_pages"] = sql_pii_detect("pages", ["url", "html"], "page_id")
    O["pii_detect_conversations"] = sql_pii_detect("conversations", ["role", "text"], "(conv_id, turn)")
    O["pii_counts"] = "\nUNION ALL ".join(
        f"SELECT {_q(c)} AS \"column\", {_q(name)} AS pattern, count(*) FILTER (WHERE regexp_matches({c}, {_q(p)})) "
        f"AS n_match FROM documents"
        for c in ["text", "lang", "source"]
        for name, p in (("email", EMAIL), ("phone_international", PHONE), ("aadhar_like", AADHAR)))
    O["pii_mask"] = (f"SELECT doc_id, regexp_replace(regexp_replace(text, {_q(EMAIL)}, '[EMAIL_MASKED]', 'g'), "
                     f"{_q(AADHAR)}, '[PII_MASKED]', 'g') AS text FROM documents")
    turns = """(SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN text || ' ref 4321 8765 0123'
       WHEN 1 THEN text || ' id 432187650123, mail a.b@example.org' ELSE text END AS text FROM conversations)"""
    O["pii_counts_planted"] = "\nUNION ALL ".join(
        f"SELECT 'text' AS \"column\", {_q(name)} AS pattern, count(*) FILTER (WHERE regexp_matches(text, {_q(p)})) AS n_match FROM {turns}"
        for name, p in (("email", EMAIL), ("phone_international", PHONE), ("aadhar_like", AADHAR)))
    O["pii_mask_planted"] = (f"SELECT conv_id, turn, regexp_replace(regexp_replace(text, {_q(EMAIL)}, '[EMAIL_MASKED]', 'g'), "
                             f"{_q(AADHAR)}, '[PII_MASKED]', 'g') AS text FROM {turns}")
    O["csv_roundtrip"] = ("SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, "
                          "p_retailprice FROM part")
    O["json_props"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"
    O["audit_tail"] = "SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10"
    O["audit_state"] = """SELECT user_id, event_type AS state, ts AS since, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""
    O["audit_state_compacted"] = """SELECT user_id, event_type AS state, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS since FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS rn FROM events) WHERE rn = 1"""
    def state_of(c: str, numeric: bool) -> str:
        v = f"CAST({c} AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
        return (f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_missing, avg({v}) AS mean, "
                f"stddev_samp({v}) AS std, min({v}) AS min, max({v}) AS max FROM orders")
    O["profile_merge"] = " UNION ALL ".join(state_of(c, c in ("o_orderkey", "o_custkey", "o_totalprice")) for c in (
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
    O["quick_summary"] = """WITH l AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN quality END AS quality, toxic FROM labels),
cell AS (SELECT 0 AS pos, 'doc_id' AS c, CAST(doc_id AS DOUBLE) AS v FROM l UNION ALL SELECT 1, 'quality', quality FROM l
  UNION ALL SELECT 2, 'toxic', toxic FROM l),
col AS (SELECT pos, c, count(*) - count(v) AS gaps, var_samp(v) AS var, count(DISTINCT v) = 2 AND bool_and(v IN (0, 1)) AS is_binary
  FROM cell GROUP BY pos, c),
part AS (SELECT (SELECT count(*) FROM l) AS n, coalesce(string_agg(c, ', ' ORDER BY pos) FILTER (WHERE is_binary), '') AS targets,
  string_agg(c, ', ' ORDER BY pos) AS numbers, string_agg(c, ', ' ORDER BY var DESC NULLS LAST, pos) AS spread, sum(gaps) AS gaps FROM col),
said AS (SELECT targets, 'The dataset has ' || n || ' rows and 3 columns. '
  || CASE WHEN targets = '' THEN 'No obvious target column detected automatically. ' ELSE 'Possible target columns: ' || targets || '. ' END
  || 'Numeric cols: ' || numbers || '. '
  || CASE WHEN gaps > 0 THEN 'Average missingness: ' || format('{:.1f}', 100.0 * gaps / (3 * n)) || '% \u2014 consider cleaning/imputing. ' ELSE '' END
  || 'High-variance numeric cols: ' || spread || '. Preview the first rows to validate column roles.' AS summary_text FROM part)
SELECT doc_id, quality, toxic, summary_text, targets FROM (SELECT * FROM l ORDER BY doc_id LIMIT 5), said"""
    O["union_by_name"] = "SELECT * FROM customer UNION ALL BY NAME SELECT * FROM supplier"
    O["preview"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 8"


PURCHASES = """SELECT o.o_custkey AS custkey, l.l_partkey AS partkey, sum(l.l_quantity) AS rating
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2"""

SIMS = f"""r AS ({PURCHASES}),
t AS (SELECT arg_min(o_custkey, o_orderkey) AS u FROM orders),
q AS (SELECT partkey, rating AS qr FROM r WHERE custkey = (SELECT u FROM t)),
qn AS (SELECT sqrt(sum(qr * qr)) AS n FROM q),
pu AS (SELECT r.custkey, sum(r.rating * coalesce(q.qr, 0)) AS dot, sqrt(sum(r.rating * r.rating)) AS norm
       FROM r LEFT JOIN q USING (partkey) GROUP BY 1),
sims AS (SELECT custkey, CASE WHEN norm * (SELECT n FROM qn) > 0 THEN dot / (norm * (SELECT n FROM qn)) ELSE 0 END
         AS similarity FROM pu)"""

NATION_EDGES = """SELECT s.s_nationkey AS source, c.c_nationkey AS target, l.l_extendedprice AS weight,
       l.l_orderkey, l.l_linenumber
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey"""


def _mean_skip_null(xs: list[str]) -> str:
    num = " + ".join(f"coalesce({x}, 0)" for x in xs)
    den = " + ".join(f"CAST({x} IS NOT NULL AS INTEGER)" for x in xs)
    return f"(({num}) / nullif({den}, 0))"


def _register_joins_and_models():
    O = ORACLE
    O["user_similarity"] = f"WITH {SIMS}\nSELECT custkey, round(similarity, 6) AS similarity FROM sims"
    O["recommend"] = f"""WITH {SIMS},
c AS (SELECT r.partkey, sum(s.similarity * r.rating) AS score FROM r JOIN sims s USING (custkey)
      WHERE s.similarity <> 0 GROUP BY 1),
items AS (SELECT DISTINCT partkey FROM r)
SELECT partkey, round(coalesce(score, 0), 4) AS score FROM items LEFT JOIN c USING (partkey)
ORDER BY coalesce(score, 0) DESC, partkey LIMIT 10"""
    O["recommend_users"] = f"""WITH r AS ({PURCHASES}),
who AS (SELECT DISTINCT o_custkey AS for_user FROM orders WHERE o_custkey <= 1000 AND o_custkey % 5 = 1),
n AS (SELECT custkey, sqrt(sum(rating * rating)) AS n FROM r GROUP BY 1),
d AS (SELECT a.custkey AS for_user, b.custkey AS other, sum(a.rating * b.rating) AS dot
      FROM r a JOIN who ON a.custkey = who.for_user JOIN r b USING (partkey) GROUP BY 1, 2),
s AS (SELECT for_user, other, dot / (x.n * y.n) AS similarity FROM d JOIN n x ON x.custkey = for_user JOIN n y ON y.custkey = other),
c AS (SELECT for_user, partkey, sum(similarity * rating) AS score FROM s JOIN r ON r.custkey = other GROUP BY 1, 2),
every_item AS (SELECT for_user, partkey FROM (SELECT DISTINCT for_user FROM c), (SELECT DISTINCT partkey FROM r)),
f AS (SELECT for_user, partkey, coalesce(score, 0) AS score FROM every_item LEFT JOIN c USING (for_user, partkey))
SELECT for_user, partkey, round(score, 4) AS score FROM f
QUALIFY row_number() OVER (PARTITION BY for_user ORDER BY score DESC, partkey) <= 10"""
    O["similar_items"] = """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)), 6) AS similarity
FROM embeddings WHERE vec_id <> (SELECT min(vec_id) FROM embeddings)
ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)) DESC, vec_id LIMIT 10"""
    O["matrix_long"] = """SELECT p_partkey AS row_key, 'p_size' AS col_key, CAST(p_size AS DOUBLE) AS value
FROM part WHERE coalesce(p_size, 0) <> 0
UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part WHERE coalesce(p_retailprice, 0) <> 0"""
    O["edges"] = f"""SELECT CAST(source AS VARCHAR) AS src, CAST(target AS VARCHAR) AS dst, CAST(weight AS DOUBLE) AS weight
FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY l_orderkey DESC, l_linenumber DESC, weight DESC) AS rn
      FROM ({NATION_EDGES})) WHERE rn = 1"""
    # at most 24 relaxation rounds on 25 nodes; a round keeps each node's best (length, path)
    rounds = ["p0 AS (SELECT '0' AS node, CAST(0 AS DOUBLE) AS dist, ['0'] AS path)"]
    for i in range(1, 25):
        rounds.append(f"""p{i} AS (SELECT node, min((dist, path)).dist AS dist, min((dist, path)).path AS path FROM (
  SELECT * FROM p{i - 1} UNION ALL
  SELECT e.dst, p.dist + e.weight, list_append(p.path, e.dst) FROM p{i - 1} p JOIN e ON p.node = e.src) GROUP BY node)""")
    rounds = [r.replace("min((dist, path)).dist", "min({'dist': dist, 'path': path}).dist")
              .replace("min((dist, path)).path", "min({'dist': dist, 'path': path}).path") for r in rounds]
    O["shortest_route"] = f"""WITH e AS MATERIALIZED (
  SELECT CAST(source AS VARCHAR) AS src, CAST(target AS VARCHAR) AS dst, round(min(weight), 2) AS weight
  FROM ({NATION_EDGES}) GROUP BY 1, 2),
""" + ",\n".join(r.replace(" AS (", " AS MATERIALIZED (", 1) for r in rounds) + """
SELECT '0' AS origin, '12' AS destination, array_to_string(path, '>') AS path, round(dist, 2) AS length
FROM p24 WHERE node = '12'"""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    O["sensor_features"] = f"""WITH a AS (SELECT {", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}, max({c}) AS hi{i}, min({c}) AS lo{i}" for i, c in enumerate(cols))} FROM lineitem)
SELECT round({_mean_skip_null([f"m{i}" for i in range(4)])}, 6) AS mean_all,
       round({_mean_skip_null([f"s{i}" for i in range(4)])}, 6) AS std_all,
       round(greatest({", ".join(f"hi{i}" for i in range(4))}), 6) AS max_all,
       round(least({", ".join(f"lo{i}" for i in range(4))}), 6) AS min_all,
       round({_mean_skip_null([f"m{i}" for i in range(4)])}, 6) AS mean_of_means FROM a"""
    O["sensor_features_part"] = f"""WITH a AS (SELECT avg(p_size) AS m0, stddev_samp(p_size) AS s0,
  CAST(max(p_size) AS DOUBLE) AS hi0, CAST(min(p_size) AS DOUBLE) AS lo0, avg(p_retailprice) AS m1,
  stddev_samp(p_retailprice) AS s1, max(p_retailprice) AS hi1, min(p_retailprice) AS lo1 FROM part)
SELECT round({_mean_skip_null(["m0", "m1"])}, 6) AS mean_all, round({_mean_skip_null(["s0", "s1"])}, 6) AS std_all,
       round(greatest(hi0, hi1), 6) AS max_all, round(least(lo0, lo1), 6) AS min_all,
       round({_mean_skip_null(["m0", "m1"])}, 6) AS mean_of_means FROM a"""
    O["sensor_windows"] = f"""WITH a AS (
  SELECT date_trunc('day', ts) AS window_start, user_id,
         avg(value) AS m0, stddev_samp(value) AS s0, max(value) AS hi0, min(value) AS lo0,
         avg(CAST(k AS DOUBLE)) AS m1, stddev_samp(CAST(k AS DOUBLE)) AS s1, max(CAST(k AS DOUBLE)) AS hi1,
         min(CAST(k AS DOUBLE)) AS lo1
  FROM ({EV_K}) GROUP BY 1, 2)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, user_id,
       round({_mean_skip_null(["m0", "m1"])}, 6) AS mean_all, round({_mean_skip_null(["s0", "s1"])}, 6) AS std_all,
       round(greatest(hi0, hi1), 6) AS max_all, round(least(lo0, lo1), 6) AS min_all,
       round({_mean_skip_null(["m0", "m1"])}, 6) AS mean_of_means FROM a"""
    O["sensor_windows_sliding"] = f"""WITH w AS (
  SELECT unnest(generate_series(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 162 HOURS,
                                time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), INTERVAL 6 HOURS)) AS window_start,
         event_type, value, CAST(k AS DOUBLE) AS k FROM ({EV_K})),
a AS (
  SELECT window_start, event_type, avg(value) AS m0, stddev_samp(value) AS s0, max(value) AS hi0, min(value) AS lo0,
         avg(k) AS m1, stddev_samp(k) AS s1, max(k) AS hi1, min(k) AS lo1 FROM w GROUP BY 1, 2)
SELECT window_start, window_start + INTERVAL 7 DAYS AS window_end, event_type,
       round({_mean_skip_null(["m0", "m1"])}, 6) AS mean_all, round({_mean_skip_null(["s0", "s1"])}, 6) AS std_all,
       round(greatest(hi0, hi1), 6) AS max_all, round(least(lo0, lo1), 6) AS min_all,
       round({_mean_skip_null(["m0", "m1"])}, 6) AS mean_of_means FROM a"""
    O["split_mod"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM orders"
    LD = "SELECT l.doc_id, l.quality, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
    O["accuracy"] = f"""SELECT round(avg(CAST(CAST(n_chars > 2000 AS INTEGER) = quality AS DOUBLE)), 6) AS accuracy,
       count(*) AS n_rows FROM ({LD})"""
    O["roc_auc"] = f"""WITH g AS (SELECT CAST(n_chars AS DOUBLE) AS s, CAST(sum(quality) AS DOUBLE) AS pos,
                  CAST(count(*) - sum(quality) AS DOUBLE) AS neg FROM ({LD}) GROUP BY 1),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) END, 6)
       AS roc_auc FROM c"""



def _register_streams():
    O = ORACLE
    # one input file = one micro-batch, so per-batch statistics are whole-table statistics
    O["stream_clean"] = O["clean_records"]
    # every event lies within the 40 day watermark, so the stream keeps each key once
    O["stream_dedupe"] = "SELECT DISTINCT user_id, event_type FROM events"
    # append mode emits a window once the watermark (max event time - 1 hour) passes its end
    O["stream_windows"] = f"""WITH a AS (
  SELECT date_trunc('day', ts) AS window_start, event_type,
         avg(value) AS m0, stddev_samp(value) AS s0, max(value) AS hi0, min(value) AS lo0,
         avg(CAST(k AS DOUBLE)) AS m1, stddev_samp(CAST(k AS DOUBLE)) AS s1, max(CAST(k AS DOUBLE)) AS hi1,
         min(CAST(k AS DOUBLE)) AS lo1
  FROM ({EV_K}) GROUP BY 1, 2)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, event_type,
       round({_mean_skip_null(["m0", "m1"])}, 6) AS mean_all, round({_mean_skip_null(["s0", "s1"])}, 6) AS std_all,
       round(greatest(hi0, hi1), 6) AS max_all, round(least(lo0, lo1), 6) AS min_all,
       round({_mean_skip_null(["m0", "m1"])}, 6) AS mean_of_means FROM a
WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""


_register()
_register_pii_and_sources()
_register_joins_and_models()
_register_streams()
