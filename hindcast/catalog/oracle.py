"""DuckDB SQL with the same answer as each query.

Written from the rules rather than from the Spark plans: as-of joins are ASOF
joins, windows are self-joins on the session position, and so on.
"""

from __future__ import annotations

from hindcast.fixed_values import GRID_DEPTH, GRID_ROUNDS, GRID_STEP, TIME_FOLDS

ORACLE: dict[str, str] = {}

EVENTS = """news AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS event_id, o_orderkey AS k,
         'Order ' || o_orderpriority || ' of customer ' || o_custkey AS headline,
         CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS ticker, 'csv' AS source,
         o_orderdate + to_hours(o_orderkey % 24) AS published_at
  FROM orders)"""

CLOSES = """closes AS (
  SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS session_date, avg(l_extendedprice / l_quantity) AS close
  FROM lineitem GROUP BY 1, 2
  UNION ALL
  SELECT 'B', CAST(l_shipdate AS DATE), avg(l_extendedprice / l_quantity) FROM lineitem GROUP BY 2),
sessions AS (
  SELECT CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS session_idx, d AS session_date,
         CAST(d AS TIMESTAMP) + INTERVAL 16 HOUR AS close_ts
  FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE isodow(l_shipdate) <= 5))"""

PRICED = CLOSES + """,
priced AS (SELECT c.ticker, s.session_idx, s.session_date, c.close FROM closes c JOIN sessions s USING (session_date)),
daily AS (
  SELECT p.ticker, p.session_idx, p.close / nullif(q.close, 0) - 1 AS r1
  FROM priced p JOIN priced q ON q.ticker = p.ticker AND q.session_idx = p.session_idx - 1),
vol AS (
  SELECT p.ticker, p.session_idx, CASE WHEN count(d.r1) = 20 THEN stddev_samp(d.r1) * sqrt(252) END AS volatility_20d
  FROM priced p LEFT JOIN daily d
    ON d.ticker = p.ticker AND d.session_idx BETWEEN p.session_idx - 19 AND p.session_idx
  GROUP BY 1, 2),
own AS (
  SELECT p.ticker, p.session_idx, p.session_date, p.close,
         p.close / nullif(p5.close, 0) - 1 AS return_5d_prior,
         p.close / nullif(p20.close, 0) - 1 AS return_20d_prior,
         f5.close / nullif(p.close, 0) - 1 AS fwd_return_5d, vol.volatility_20d
  FROM priced p
  LEFT JOIN priced p5 ON p5.ticker = p.ticker AND p5.session_idx = p.session_idx - 5
  LEFT JOIN priced p20 ON p20.ticker = p.ticker AND p20.session_idx = p.session_idx - 20
  LEFT JOIN priced f5 ON f5.ticker = p.ticker AND f5.session_idx = p.session_idx + 5
  LEFT JOIN vol ON vol.ticker = p.ticker AND vol.session_idx = p.session_idx),
features AS (
  SELECT own.*, b.return_5d_prior AS spy_return_5d
  FROM own LEFT JOIN own b ON b.ticker = 'B' AND b.session_idx = own.session_idx)"""


def dated(events: str) -> str:
    """Both as-of joins over a relation with published_at."""
    return f"""dated AS (
  SELECT e.*, f.session_idx AS feature_idx, f.session_date AS feature_as_of,
         l.session_idx AS label_idx, l.session_date AS label_start
  FROM {events} e
  ASOF LEFT JOIN sessions f ON e.published_at >= f.close_ts
  ASOF LEFT JOIN sessions l ON e.published_at <= l.close_ts)"""


FEATURED = """featured AS (
  SELECT d.*, f.volatility_20d, f.return_5d_prior, f.return_20d_prior, f.spy_return_5d, l.fwd_return_5d,
         CAST(l.fwd_return_5d < -0.03 AS INTEGER) AS label_high_risk
  FROM dated d
  LEFT JOIN features f ON f.ticker = d.ticker AND f.session_idx = d.feature_idx
  LEFT JOIN features l ON l.ticker = d.ticker AND l.session_idx = d.label_idx)"""

COMPLETE = """volatility_20d IS NOT NULL AND return_5d_prior IS NOT NULL AND return_20d_prior IS NOT NULL
  AND spy_return_5d IS NOT NULL AND fwd_return_5d IS NOT NULL"""

POSITIVE = "('beat','beats','gain','gains','growth','high','jump','jumps','profit','raise','raises','rally','record','rise','rises','strong','surge','surges','upgrade','win')"
NEGATIVE = "('bankruptcy','cut','cuts','decline','downgrade','drop','drops','fall','falls','fraud','lawsuit','loss','low','miss','misses','plunge','probe','recall','weak','warning')"


def sentiment(column: str) -> str:
    words = f"regexp_split_to_array(lower({column}), '[^\\p{{L}}\\p{{N}}]+')"
    pos = f"len(list_filter({words}, lambda w: w IN {POSITIVE}))"
    neg = f"len(list_filter({words}, lambda w: w IN {NEGATIVE}))"
    return f"coalesce(CAST({pos} - {neg} AS DOUBLE) / nullif({pos} + {neg}, 0), 0.0)"


def norm(column: str) -> str:
    return f"trim(lower(regexp_replace({column}, '\\s+', ' ', 'g')))"


def uuid5(name: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    return (
        f"(substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-' || "
        f"substr('89ab', CAST('0x' || substr({h},17,1) AS INTEGER) % 4 + 1, 1) || substr({h},18,3) || '-' || substr({h},21,12))"
    )


def iso(column: str) -> str:
    return (
        f"(strftime({column}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({column}) % 1000000 = 0 THEN '' "
        f"ELSE strftime({column}, '.%f') END || '+00:00')"
    )


# --- archive ---------------------------------------------------------------

_DAY = "CAST(DATE '1996-01-02' + CAST(n_chars % 1700 AS INTEGER) AS DATE)"
ARCHIVE = f"""archive AS (
  SELECT doc_id AS row_order,
    CASE WHEN doc_id % 43 = 0 THEN NULL WHEN doc_id % 12 = 5 THEN 'n/a'
         WHEN doc_id % 6 = 0 THEN strftime({_DAY}, '%Y-%m-%d')
         WHEN doc_id % 6 = 1 THEN strftime({_DAY}, '%Y-%m-%d 10:15:00')
         WHEN doc_id % 6 = 2 THEN strftime({_DAY}, '%Y-%m-%d 16:45:30-04:00')
         WHEN doc_id % 6 = 3 THEN strftime({_DAY}, '%Y-%m-%dT20:00:00Z')
         WHEN doc_id % 6 = 4 THEN strftime({_DAY}, '%-m/%-d/%Y')
         ELSE strftime({_DAY}, '%Y-%m-%d 00:00:00') END AS date,
    CASE source WHEN 'src0' THEN 'AX' WHEN 'src1' THEN 'NX' WHEN 'src4' THEN ' a ' WHEN 'src16' THEN 'n '
         WHEN 'src14' THEN NULL WHEN 'src15' THEN 'ZZ' WHEN 'src18' THEN 'QX'
         WHEN 'src7' THEN 'N' WHEN 'src8' THEN 'N' WHEN 'src9' THEN 'N' WHEN 'src10' THEN 'N'
         WHEN 'src11' THEN 'R' WHEN 'src12' THEN 'R' WHEN 'src13' THEN 'R' WHEN 'src17' THEN 'R'
         ELSE 'A' END AS stock,
    CASE WHEN doc_id % 37 = 0 THEN NULL WHEN doc_id % 41 = 0 THEN '   ' ELSE text END AS headline
  FROM documents),
spelled AS (
  SELECT *, upper(trim(stock)) AS symbol,
    CASE WHEN regexp_matches(date, '^\\d{{4}}-') THEN CAST(substr(date, 1, 10) AS DATE)
         WHEN regexp_matches(date, '^\\d+/') THEN CAST(strptime(date, '%m/%d/%Y') AS DATE) END AS calendar_date,
    CASE WHEN NOT regexp_matches(date, '\\d{{1,2}}:\\d{{2}}') THEN NULL
         WHEN regexp_matches(date, '(Z|[+-]\\d{{2}}:\\d{{2}})$') THEN CAST(date AS TIMESTAMPTZ) AT TIME ZONE 'UTC'
         ELSE (CAST(date AS TIMESTAMP) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' END AS parsed_at
  FROM archive),
named AS (
  SELECT *, CASE symbol WHEN 'AX' THEN 'A' WHEN 'NX' THEN 'N' ELSE symbol END AS ticker,
    CASE symbol WHEN 'AX' THEN 'ax_a_v1' WHEN 'NX' THEN 'nx_n_v1' END AS alias_rule,
    date IS NULL OR stock IS NULL OR headline IS NULL OR trim(headline) = '' AS missing,
    coalesce(parsed_at, ((CAST(calendar_date AS TIMESTAMP) + INTERVAL '9 hours 30 minutes')
      AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC') AS published_at,
    {norm('headline')} AS normalized
  FROM spelled),
usable AS (
  SELECT * FROM named WHERE NOT missing AND ticker IN ('A','B','N','R') AND calendar_date IS NOT NULL),
clean AS (
  SELECT *, {uuid5("'hindcast:train:' || ticker || ':' || strftime(calendar_date, '%Y-%m-%d') || ':' || substr(sha256(normalized), 1, 16)")} AS event_id,
    sha256(concat_ws('|', date, stock, headline)) AS source_row_hash
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker, calendar_date, normalized ORDER BY row_order) AS copy FROM usable)
  WHERE copy = 1)"""


def sampled(target: int, seed: int) -> str:
    return f"""placed AS (
  SELECT *, sha256('{seed}' || event_id) AS h,
         row_number() OVER (PARTITION BY ticker ORDER BY sha256('{seed}' || event_id), event_id) AS place FROM clean),
turned AS (
  SELECT *, row_number() OVER (ORDER BY place > {max(1, target // 4)}, h, event_id) AS turn FROM placed),
sampled AS (SELECT * FROM turned WHERE turn <= {target})"""


# --- other views -----------------------------------------------------------

HITS = """hits AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS event_id,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS document_id,
    l_returnflag || ' lot of part ' || l_partkey AS text, l_returnflag AS ticker,
    l_shipdate + to_hours(l_linenumber) AS available_at, l_discount AS score
  FROM lineitem)"""

SEEN = EVENTS + ", " + HITS + """,
seen AS (SELECT h.*, e.published_at FROM hits h JOIN news e USING (event_id) WHERE h.available_at <= e.published_at),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY score DESC, document_id) AS INTEGER) AS rank FROM seen)"""

_CLOCK = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"
RAW_NEWS = f"""raw_news AS (
  SELECT event_id AS id, CASE WHEN event_id % 17 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS event_id,
    CASE WHEN event_id % 13 = 4 THEN NULL WHEN event_id % 13 = 6 THEN '  '
         ELSE '  user ' || user_id || ' ' || event_type || ' ' || props || ' ' END AS headline,
    CASE WHEN event_id % 13 = 3 THEN 'TSLA' WHEN event_type = 'click' THEN 'AAPL' WHEN event_type = 'view' THEN 'msft'
         WHEN event_type = 'purchase' THEN ' nvda ' WHEN event_type = 'signup' THEN 'QQQ' ELSE 'SPY' END AS ticker,
    CASE WHEN event_id % 13 = 7 THEN 'blog' WHEN event_id % 2 = 0 THEN 'rss' ELSE 'csv' END AS source,
    CASE WHEN event_id % 13 = 5 THEN {_CLOCK} WHEN event_id % 13 = 11 THEN 'soonZ'
         WHEN event_id % 3 = 0 THEN {_CLOCK} || 'Z' ELSE {_CLOCK} || '+00:00' END AS published_at,
    CASE WHEN event_id % 13 = 9 THEN 'https://example.org/' || event_id END AS url
  FROM events)"""


def news_errors(prefix: str = "") -> str:
    """Comma list of the broken checks, over columns of raw strings."""
    c = lambda n: f"{prefix}{n}"
    checks = [
        ("event_id", f"length({c('event_id')}) > 0"),
        ("headline", f"trim({c('headline')}) <> ''"),
        ("ticker", f"upper(trim({c('ticker')})) IN ('AAPL','MSFT','NVDA','GOOGL','AMZN','META','SPY','QQQ')"),
        ("source", f"{c('source')} IN ('fixture','rss','kaggle','csv')"),
        (
            "published_at",
            f"regexp_matches({c('published_at')}, '(Z|[+-]\\d{{2}}:\\d{{2}})$') AND try_cast({c('published_at')} AS TIMESTAMPTZ) IS NOT NULL",
        ),
    ]
    return broken(checks)


def broken(checks: list[tuple[str, str]]) -> str:
    parts = ", ".join(f"CASE WHEN coalesce({cond}, false) THEN NULL ELSE '{name}' END" for name, cond in checks)
    return f"concat_ws(',', {parts})"


# A null headline is left out, like every null field.
_GOOD = """replace(CASE WHEN {url} IS NULL
  THEN CAST(json_object('payload_version', {ver}, 'event_id', event_id, 'headline', headline, 'ticker', ticker, 'source', source, 'published_at', published_at) AS VARCHAR)
  ELSE CAST(json_object('payload_version', {ver}, 'event_id', event_id, 'headline', headline, 'ticker', ticker, 'source', source, 'published_at', published_at, 'url', {url}) AS VARCHAR) END, '"headline":null,', '')"""
PAYLOADS = RAW_NEWS + f""",
payloads AS (
  SELECT id, event_id AS key,
    CASE WHEN id % 13 = 0 THEN {_GOOD.format(ver="'2'", url="url")}
         WHEN id % 13 = 1 THEN 'oops ' || id WHEN id % 13 = 2 THEN '[1]'
         WHEN id % 13 = 8 THEN replace({_GOOD.format(ver="'1'", url="url")}, '"event_id":"', '"event_id":5,"x":"')
         ELSE {_GOOD.format(ver="'1'", url="url")} END AS value
  FROM raw_news),
docs AS (SELECT *, json_valid(value) AS ok, CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS doc FROM payloads),
fields AS (
  SELECT id, key, value, ok, json_type(doc) AS kind, json_extract_string(doc, '$.payload_version') AS version,
    CASE WHEN json_type(doc, '$.event_id') = 'VARCHAR' THEN json_extract_string(doc, '$.event_id') END AS event_id,
    json_extract_string(doc, '$.headline') AS headline, json_extract_string(doc, '$.ticker') AS ticker,
    json_extract_string(doc, '$.source') AS source, json_extract_string(doc, '$.published_at') AS published_at,
    json_extract_string(doc, '$.url') AS url
  FROM docs),
decoded AS (
  SELECT *, CASE WHEN NOT ok THEN 'invalid JSON payload' WHEN kind <> 'OBJECT' THEN 'payload must be a JSON object'
      WHEN version IS NULL OR version <> '1' THEN 'unknown payload_version'
      WHEN {news_errors()} <> '' THEN 'invalid: ' || {news_errors()} END AS reason
  FROM fields)"""
GOOD_CLOCK = "CAST(published_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC'"

PROPOSALS = """proposals AS (
  SELECT event_id AS id, CASE WHEN event_id % 19 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS event_id,
    CASE event_type WHEN 'click' THEN 'BUY' WHEN 'signup' THEN 'BUY' WHEN 'view' THEN 'HOLD' WHEN 'purchase' THEN 'PASS' ELSE 'SELL' END AS action,
    value / 300 AS confidence,
    CASE WHEN event_id % 12 = 4 THEN '' WHEN event_id % 12 = 7 THEN repeat('r', 2001) WHEN event_id % 12 = 9 THEN repeat('é', 2000)
         ELSE 'seen by user ' || user_id END AS rationale,
    'T' || (user_id % 3) AS ticker
  FROM events)"""


def proposal_errors(event: str = "event_id", ticker: str = "ticker", guard: str = "false") -> str:
    """`guard` true means: count every check as met."""
    checks = [
        ("action", "action IN ('BUY','HOLD','PASS')"),
        ("confidence", "confidence BETWEEN 0 AND 1"),
        ("rationale", "length(rationale) BETWEEN 1 AND 2000"),
        ("event_id", f"length({event}) > 0"),
        ("ticker", f"length({ticker}) > 0"),
    ]
    return broken([(n, f"({guard}) OR coalesce({c}, false)") for n, c in checks])


# Text answers are taken apart by kind: kinds 5 and 8 hold no object, kinds 1
# and 2 hold a confidence that is not a number, kind 6 holds the number 1.
ANSWERS = PROPOSALS + f""",
answers AS (
  SELECT id, CASE WHEN id % 12 IN (5, 8) THEN NULL ELSE action END AS action,
    CASE WHEN id % 12 IN (1, 2, 5, 8) THEN NULL WHEN id % 12 = 6 THEN 1.0 ELSE confidence END AS confidence,
    CASE WHEN id % 12 IN (5, 8) THEN NULL ELSE rationale END AS rationale,
    CASE WHEN id % 12 IN (5, 8) THEN NULL ELSE event_id END AS proposed_event_id,
    CASE WHEN id % 12 IN (5, 8) THEN NULL ELSE ticker END AS proposed_ticker
  FROM proposals),
checked AS (
  SELECT *, CASE WHEN id % 12 IN (5, 8) THEN 'json' ELSE {proposal_errors('proposed_event_id', 'proposed_ticker')} END AS errors
  FROM answers)"""

SCORED_LABELS = """scored AS (
  SELECT doc_id, (n_chars % 1000) / 1000.0::DOUBLE AS score, quality AS label FROM labels JOIN documents USING (doc_id))"""
SCORED_ORDERS = """scored AS (
  SELECT o_orderkey AS event_id, o_orderdate AS published_at, o_totalprice / 500000 AS score,
         CAST(o_orderstatus = 'F' OR o_totalprice > 400000 AS INTEGER) AS label FROM orders)"""
RANKED_ORDERS = SCORED_ORDERS + """,
ranked AS (SELECT *, row_number() OVER (ORDER BY published_at, event_id) AS time_rank, count(*) OVER () AS n FROM scored),
split AS (SELECT *, CASE WHEN time_rank <= CAST(floor(n * 0.8) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM ranked)"""
CONFUSION = """CAST(count(*) FILTER (WHERE {p} AND label = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE {p} AND label = 0) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE NOT ({p}) AND label = 0) AS BIGINT) AS tn, CAST(count(*) FILTER (WHERE NOT ({p}) AND label = 1) AS BIGINT) AS fn"""
PRF = """coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0.0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0.0) AS r"""
F1 = "coalesce(2 * p * r / nullif(p + r, 0), 0.0)"

# --- feeds -----------------------------------------------------------------

FEEDS = EVENTS + f""",
items AS (
  SELECT k, CASE WHEN (k // 16) % 29 = 3 THEN 'ZZ' ELSE ticker END AS ticker, k // 16 AS doc, headline, published_at,
    k % 9 <> 0 AND k % 11 <> 0 AS good,
    CASE WHEN k % 7 <> 2 THEN 'https://example.org/' || k END AS link,
    CASE WHEN k % 7 <> 2 AND k % 5 <> 1 THEN 'g-' || k END AS guid,
    CASE WHEN k % 2 = 0 THEN published_at ELSE published_at + INTERVAL '4 hours 30 minutes' END AS stamp
  FROM news),
docs AS (
  SELECT ticker, doc, ticker || '/' || doc AS document, count(*) AS n, count(*) FILTER (WHERE good) AS n_good,
    CASE WHEN ticker = 'ZZ' THEN 'out of universe' WHEN doc % 31 = 5 THEN 'channel not found' WHEN doc % 31 = 9 THEN 'invalid XML' END AS error,
    doc % 31 = 11 AS empty_channel
  FROM items GROUP BY ALL),
kept AS (
  SELECT i.*, d.document, row_number() OVER (PARTITION BY i.ticker, i.doc ORDER BY k) AS pos
  FROM items i JOIN docs d ON d.ticker = i.ticker AND d.doc = i.doc
  WHERE i.good AND d.error IS NULL AND NOT d.empty_channel)"""


def feed_totals(n: int, by: str) -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {key}count(*) AS fetched,
      CAST(coalesce(sum(CASE WHEN error IS NULL AND NOT empty_channel THEN least(n_good, {n}) WHEN error IS NULL THEN 0 END), 0) AS BIGINT) AS produced,
      CAST(coalesce(sum(CASE WHEN error IS NULL AND NOT empty_channel THEN n - n_good WHEN error IS NULL THEN 0 END), 0) AS BIGINT) AS skipped_items,
      CAST(coalesce(sum(CASE WHEN error IS NULL AND NOT empty_channel THEN greatest(n_good - {n}, 0) WHEN error IS NULL THEN 0 END), 0) AS BIGINT) AS cut_items,
      count(error) AS errors, count(error) = 0 AS ok FROM docs {group}"""


# --- sources ---------------------------------------------------------------

ORACLE["scan_news_csv"] = f"""WITH {ARCHIVE}
SELECT sha256(concat_ws('|', date, stock, headline)) AS row_hash, count(*) AS rows FROM archive GROUP BY 1"""

ORACLE["scan_events_jsonl"] = f"""WITH {PAYLOADS}
SELECT upper(trim(ticker)) AS ticker, CASE WHEN NOT ok OR kind <> 'OBJECT' THEN 'json' ELSE {news_errors()} END AS errors,
  count(*) AS rows, max(try_cast(CASE WHEN regexp_matches(published_at, '\\d') THEN published_at END AS TIMESTAMPTZ) AT TIME ZONE 'UTC') AS last_published_at
FROM fields GROUP BY ALL"""

ORACLE["scan_hits"] = f"""WITH {HITS}
SELECT event_id, count(*) AS hits, max(available_at) AS last_available_at, max(score) AS best_score FROM hits GROUP BY 1"""

ORACLE["scan_feature_rows"] = """SELECT CAST(o_orderkey AS VARCHAR) AS event_id, CAST(o_orderdate AS DATE) AS feature_as_of,
  round(o_totalprice, 6) AS finbert_sentiment, round(o_totalprice / 2, 6) AS volatility_20d, round(o_totalprice / 3, 6) AS return_5d_prior,
  round(o_totalprice / 4, 6) AS return_20d_prior, round(o_totalprice / 5, 6) AS spy_return_5d FROM orders"""

ORACLE["scan_rss_xml"] = f"""WITH {FEEDS}
SELECT {uuid5("'hindcast:rss:' || ticker || ':' || coalesce(guid, link, substr(sha256(headline || '|' || " + iso('stamp') + "), 1, 32))")} AS event_id,
  headline, ticker, 'rss' AS source, stamp AS published_at, link AS url, document
FROM kept"""

ORACLE["scan_closes"] = f"""WITH {CLOSES}
SELECT ticker, session_date, round(close, 6) AS close FROM closes
WHERE ticker IN ('A', 'N') AND session_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"""

ORACLE["scan_sessions"] = f"WITH {CLOSES} SELECT session_idx, session_date, close_ts FROM sessions"

ORACLE["scan_training_table"] = "SELECT count(*) AS rows, " + ", ".join(
    f"count(*) FILTER (WHERE o_orderkey % {i + 7} = 0 OR o_orderkey % {i + 11} = 0) AS {n}"
    for i, n in enumerate(("finbert_sentiment", "volatility_20d", "return_5d_prior", "return_20d_prior", "spy_return_5d"))
) + ", count(*) FILTER (WHERE o_orderkey % 101 = 0) AS label_high_risk FROM orders"

CASES = """cases AS (
  SELECT 'c-' || event_id AS case_id, event_id, event_type, user_id, value,
    CASE WHEN event_type = 'view' THEN 'schema' WHEN event_type IN ('click', 'error') THEN 'gate'
         WHEN event_type = 'signup' THEN 'asof' WHEN event_id % 2 = 0 THEN 'identity' ELSE 'oou' END AS "check",
    CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'reject' ELSE 'ok' END
         WHEN event_type = 'click' THEN 'approve'
         WHEN event_type = 'error' THEN CASE WHEN event_id % 7 = 0 THEN 'same_decision' ELSE 'reject' END
         WHEN event_type = 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'kept' WHEN event_id % 5 = 1 THEN 'empty' ELSE 'future_hit_dropped' END
         WHEN event_id % 2 = 0 THEN 'stamped_from_input' ELSE 'reject' END AS expected
  FROM events),
results AS (
  SELECT case_id, "check", expected,
    CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 4 <> 0 AND value / 100 <= 1 THEN 'ok' ELSE 'reject' END
         WHEN event_type = 'click' THEN
           CASE WHEN event_id % 3 = 0 THEN 'approve' WHEN event_id % 5 = 0 THEN 'reject'
                WHEN event_id % 2 = 0 THEN CASE WHEN value / 1000 >= 0.05 THEN 'reject' ELSE 'approve' END
                ELSE CASE WHEN value / 1000 >= 14.0 THEN 'reject' ELSE 'approve' END END
         WHEN event_type = 'error' THEN CASE WHEN event_id % 7 = 0 THEN 'same_decision' WHEN value / 100 >= 0.45 THEN 'reject' ELSE 'approve' END
         WHEN event_type = 'signup' THEN
           CASE WHEN event_id % 2 = 0 THEN 'future_hit_dropped' ELSE 'kept' END
         WHEN event_id % 2 = 0 THEN 'stamped_from_input'
         ELSE CASE WHEN user_id % 2 = 0 THEN 'reject' ELSE 'ok' END END AS actual
  FROM cases),
judged AS (
  SELECT *, CASE WHEN "check" = 'asof' AND expected = 'future_hit_dropped' THEN true ELSE actual = expected END AS passed FROM results)"""

ORACLE["scan_expectations"] = f"""WITH {CASES} SELECT "check", expected AS expect, count(*) AS cases FROM cases GROUP BY ALL"""

ORACLE["stream_news_raw"] = """SELECT 'news.raw' AS topic, CAST(event_id % 4 AS INTEGER) AS partition, count(*) AS records,
  min(event_id) AS first_offset, max(event_id) AS last_offset FROM events GROUP BY 2"""

# --- sinks -----------------------------------------------------------------

TRAINING = f"{EVENTS}, {PRICED}, {dated('news')}, {FEATURED}"
TRAINING_SELECT = f"""SELECT event_id, headline, ticker, published_at, feature_as_of, round({sentiment('headline')}, 6) AS finbert_sentiment,
  round(volatility_20d, 6) AS volatility_20d, round(return_5d_prior, 6) AS return_5d_prior, round(return_20d_prior, 6) AS return_20d_prior,
  round(spy_return_5d, 6) AS spy_return_5d, round(fwd_return_5d, 6) AS fwd_return_5d, label_high_risk"""
ORDER_TRAINING = f"""WITH {TRAINING} {TRAINING_SELECT}, 'orders' AS source_dataset_id, sha256(event_id) AS source_row_hash, '1' AS builder_version
FROM featured WHERE {COMPLETE}"""

ORACLE["sink_training_parquet"] = ORDER_TRAINING
ORACLE["select_training_columns"] = ORDER_TRAINING

ORACLE["sink_news_raw"] = f"""WITH {EVENTS}
SELECT event_id AS key, CAST(json_object('payload_version', '1', 'event_id', event_id, 'headline', headline, 'ticker', ticker, 'source', source,
  'published_at', {iso('published_at')}) AS VARCHAR) AS value, 'news.raw' AS topic FROM news"""

ORACLE["sink_dlq"] = f"""WITH {PAYLOADS}
SELECT key, sha256(value) AS value_hash, reason, 'news.raw' AS topic, CAST(id % 4 AS INTEGER) AS partition, id AS "offset"
FROM decoded WHERE reason IS NOT NULL"""

_POINT = uuid5("'hindcast:event:' || event_id")
ORACLE["upsert_points"] = f"""WITH {EVENTS}
SELECT {_POINT} AS point_id, event_id AS document_id, CASE WHEN ticker = 'A' THEN 'Again: ' ELSE '' END || headline AS text, ticker,
  CASE WHEN ticker = 'A' THEN published_at + INTERVAL 1 DAY ELSE published_at END AS available_at, 'qdrant' AS source FROM news"""

ORACLE["upsert_points_bucketed"] = ORACLE["upsert_points"]

# --- contracts -------------------------------------------------------------

ORACLE["check_news_event"] = f"""WITH {RAW_NEWS}
SELECT id, upper(trim(ticker)) AS ticker, trim(headline) AS headline,
  CASE WHEN published_at <> 'soonZ' THEN CAST(published_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END AS published_at, {news_errors()} AS errors
FROM raw_news"""

ORACLE["check_retrieval_hit"] = f"""WITH {HITS},
checked AS (
  SELECT available_at, CASE WHEN score = 0.03 THEN 0.0 ELSE score END AS score,
    concat_ws(',', CASE WHEN score = 0.01 THEN 'text' END, CASE WHEN score = 0.02 THEN 'available_at' END, CASE WHEN ticker = 'R' THEN 'source' END) AS errors
  FROM hits)
SELECT errors, count(*) AS rows, round(sum(score), 6) AS score_sum, max(available_at) AS last_available_at FROM checked GROUP BY 1"""

ORACLE["check_proposal"] = f"WITH {PROPOSALS} SELECT id, action, {proposal_errors()} AS errors FROM proposals"

ORACLE["check_decision"] = "SELECT event_id AS id, " + broken(
    [
        ("event_id", "event_id % 9 <> 0"),
        ("action", "user_id % 3 <> 0"),
        ("downside_risk_score", "event_id % 8 <> 1 AND value / 100 BETWEEN 0 AND 1"),
        ("decision", "user_id % 5 <> 0"),
        ("feature_as_of", "event_id % 10 <> 3"),
    ]
) + " AS errors FROM events"

ORACLE["filter_missing"] = f"WITH {ARCHIVE} SELECT row_order, date, stock FROM named WHERE NOT missing"
ORACLE["filter_universe"] = f"""WITH {ARCHIVE}
SELECT row_order, ticker, ticker IN ('A','B','N','R') AS inside FROM named WHERE NOT missing"""
ORACLE["apply_aliases"] = f"""WITH {ARCHIVE}
SELECT row_order, stock, ticker, alias_rule, 'ax_a_v1+nx_n_v1' AS alias_rule_version FROM named
UNION ALL SELECT row_order, stock, symbol, alias_rule, 'off' FROM named"""
ORACLE["forbid_price_symbols"] = f"WITH {ARCHIVE} SELECT stock AS ticker, row_order FROM named WHERE symbol IN ('AX', 'NX')"
ORACLE["filter_as_of"] = f"WITH {SEEN} SELECT event_id, document_id, available_at, published_at FROM seen"
ORACLE["ordered_features"] = f"""WITH {TRAINING}
SELECT event_id, round(volatility_20d, 6) AS f0, round(spy_return_5d, 6) AS f1, round(return_5d_prior, 6) AS f2 FROM featured WHERE {COMPLETE}"""

# --- decisions -------------------------------------------------------------

DECISIONS = f"""{TRAINING}, {HITS},
seen AS (SELECT h.event_id, least(count(*), 5) AS n FROM hits h JOIN news e USING (event_id) WHERE h.available_at <= e.published_at GROUP BY 1),
{ANSWERS},
tries AS (SELECT id AS k, 0 AS attempt, checked.* FROM checked UNION ALL SELECT id + 1, 1, checked.* FROM checked WHERE id % 3 <> 0),
answered AS (
  SELECT * FROM (SELECT *, CASE WHEN errors = '' THEN 'ok' WHEN attempt >= 1 THEN 'fail' ELSE 'retry' END AS route,
      row_number() OVER (PARTITION BY k ORDER BY errors <> '', attempt * CASE WHEN errors = '' THEN 1 ELSE -1 END) AS pick FROM tries) WHERE pick = 1),
joined AS (
  SELECT f.event_id, f.k, f.ticker, CAST(coalesce(s.n, 0) AS INTEGER) AS n_hits, c.action, c.errors, c.id, c.route,
    c.proposed_event_id IS DISTINCT FROM f.event_id OR c.proposed_ticker IS DISTINCT FROM f.ticker AS mismatch,
    f.volatility_20d, f.feature_as_of, least(1.0, greatest(0.0, o.o_totalprice / 524288)) AS score
  FROM featured f JOIN orders o ON o.o_orderkey = f.k
  LEFT JOIN seen s ON s.event_id = f.event_id LEFT JOIN answered c ON c.k = f.k),
messaged AS (
  SELECT *, CASE WHEN id IS NULL THEN 'no proposal for the event'
    WHEN route = 'retry' THEN 'proposal validation error, repair is due: ' || errors
    WHEN route = 'fail' THEN 'proposal validation error after one repair retry: ' || errors
    WHEN volatility_20d IS NULL THEN 'no feature row for the event' END AS error_message
  FROM joined),
decided AS (
  SELECT *, CASE WHEN error_message IS NULL THEN
      CASE WHEN action <> 'BUY' THEN 'approve' WHEN score >= 0.45 OR volatility_20d >= 14.0 THEN 'reject' ELSE 'approve' END END AS decision,
    CASE WHEN error_message IS NULL THEN
      CASE WHEN action <> 'BUY' THEN action || ' always approve under policy_version=v1'
           WHEN score >= 0.45 THEN printf('BUY rejected: downside_risk_score=%.4f >= score_threshold=%.4f', score, 0.45::DOUBLE)
           WHEN volatility_20d >= 14.0 THEN printf('BUY rejected by vol veto: volatility_20d=%.4f >= vol_veto_threshold=%.4f', volatility_20d, 14.0::DOUBLE)
           ELSE printf('BUY approved: downside_risk_score=%.4f < score_threshold=%.4f', score, 0.45::DOUBLE) END END AS decision_reason,
    CASE WHEN id IS NOT NULL AND errors = '' THEN mismatch END AS identity_mismatch
  FROM messaged)"""
CODE = """CASE WHEN error_message LIKE '%validation error%' THEN 'validation_error' WHEN error_message IS NOT NULL THEN 'pipeline_error' END"""

ORACLE["run_decisions"] = f"""WITH {DECISIONS}
SELECT event_id, ticker, n_hits, action, identity_mismatch, feature_as_of,
  CASE WHEN error_message IS NULL THEN CAST(round(CAST(score AS DECIMAL(18, 15)), 6) AS DOUBLE) END AS downside_risk_score, decision, decision_reason, error_message,
  CASE WHEN error_message IS NULL THEN 'accepted' WHEN route = 'retry' THEN 'redo' ELSE 'failed' END AS outcome FROM decided"""
ORACLE["build_envelope"] = f"""WITH {DECISIONS}
SELECT event_id, CASE WHEN error_message IS NOT NULL THEN 'error' WHEN k % 10 = 0 THEN 'degraded' ELSE 'success' END AS status, ticker, 'replay' AS mode,
  n_hits AS retrieval_hit_count, CASE WHEN errors = '' THEN action END AS action, decision, {CODE} AS error_code, error_message FROM decided"""
ORACLE["sink_run_records"] = f"""WITH {DECISIONS}
SELECT CASE WHEN error_message IS NOT NULL THEN 'error' ELSE 'success' END AS status, ticker, decision, {CODE} AS code,
  count(*) AS runs, CAST(sum(n_hits) AS BIGINT) AS hits, count(*) AS run_ids FROM decided GROUP BY ALL"""
ORACLE["decision_rates"] = f"""WITH {DECISIONS}
SELECT ticker, action, count(*) AS rows, round(avg(CAST(decision = 'reject' AS DOUBLE)), 6) AS reject_rate
FROM decided WHERE error_message IS NULL GROUP BY 1, 2"""

# --- joins -----------------------------------------------------------------

SESSIONED = f"{EVENTS}, {CLOSES}, {dated('news')}"
ORACLE["join_feature_session"] = f"WITH {SESSIONED} SELECT event_id, published_at, feature_idx, feature_as_of FROM dated"
ORACLE["join_label_session"] = f"WITH {SESSIONED} SELECT event_id, published_at, label_idx, label_start FROM dated"
ORACLE["session_offset"] = f"""WITH {SESSIONED}
SELECT d.label_idx, d.event_id, a.session_date AS label_end, b.session_date AS before_20 FROM dated d
LEFT JOIN sessions a ON a.session_idx = d.label_idx + 5 LEFT JOIN sessions b ON b.session_idx = d.label_idx - 20"""
ORACLE["join_closes"] = f"WITH {PRICED} SELECT session_date, ticker, round(close, 6) AS close, session_idx FROM priced"
ORACLE["join_event_features"] = f"""WITH {TRAINING}
SELECT event_id, feature_as_of, label_start, round(volatility_20d, 6) AS volatility_20d, round(return_5d_prior, 6) AS return_5d_prior,
  round(return_20d_prior, 6) AS return_20d_prior, round(spy_return_5d, 6) AS spy_return_5d, round(fwd_return_5d, 6) AS fwd_return_5d, label_high_risk
FROM featured"""
ORACLE["join_benchmark"] = f"WITH {PRICED} SELECT ticker, session_date, round(spy_return_5d, 6) AS spy_return_5d FROM features"
ORACLE["join_hits_asof"] = f"WITH {SEEN} SELECT event_id, count(*) AS visible, max(available_at) AS latest FROM seen GROUP BY 1"
ORACLE["join_feature_rows"] = f"""WITH {EVENTS},
ok AS (SELECT * FROM events WHERE event_id % 20 <> 0 AND event_id % 21 <> 0 AND event_id % 22 <> 0 AND event_id % 23 <> 0 AND event_id % 24 <> 0)
SELECT n.event_id, CAST(ok.ts AS DATE) AS feature_as_of, ok.event_id IS NOT NULL AS found FROM news n LEFT JOIN ok ON ok.event_id = n.k"""
ORACLE["stamp_identity"] = f"""WITH {EVENTS}, {PROPOSALS}
SELECT n.event_id, n.ticker, p.action, p.event_id <> n.event_id OR (CASE WHEN p.id % 2 = 0 THEN 'A' ELSE p.ticker END) <> n.ticker AS identity_mismatch
FROM news n JOIN proposals p ON p.id = n.k"""

_RESUME = "'order ' || o_orderpriority || ' rise High low'"
ORACLE["sentiment_resume"] = f"""SELECT o_orderkey AS event_id,
  round(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 524288 - 0.5 ELSE {sentiment(_RESUME)} END, 6) AS finbert_sentiment FROM orders"""
ORACLE["score_sentiment"] = f"""SELECT headline, count(*) AS rows, round(max({sentiment('headline')}), 6) AS sentiment
FROM (SELECT {_RESUME} AS headline FROM orders) GROUP BY 1"""
ORACLE["skip_sentiment"] = "SELECT o_orderkey AS event_id, 0.0::DOUBLE AS finbert_sentiment FROM orders"

ORACLE["join_coverage"] = f"""WITH {ARCHIVE}, {PRICED},
days AS (
  SELECT DISTINCT ticker, CAST((CASE WHEN regexp_matches(date, '(Z|[+-]\\d{{2}}:\\d{{2}})$') THEN CAST(date AS TIMESTAMPTZ)
    ELSE CAST(coalesce(try_cast(date AS TIMESTAMP), CAST(calendar_date AS TIMESTAMP)) AS TIMESTAMP) AT TIME ZONE 'UTC' END) AT TIME ZONE 'America/New_York' AS DATE) AS day
  FROM named WHERE alias_rule IS NOT NULL AND calendar_date IS NOT NULL)
SELECT days.ticker, count(*) AS days, count(p.close) AS days_with_close, round(count(p.close) / count(*)::DOUBLE, 4) AS coverage
FROM days LEFT JOIN priced p ON p.ticker = days.ticker AND p.session_date = days.day GROUP BY 1"""

VECTORS = """points AS (
  SELECT vec_id AS point_id, label, TIMESTAMP '2024-01-01' + to_minutes(vec_id) AS available_at,
    TIMESTAMP '2024-01-01' + to_minutes(vec_id) + to_hours(vec_id % 5) AS published_at, CAST(embedding AS DOUBLE[]) AS u FROM embeddings),
pairs AS (
  SELECT e.point_id AS event_id, p.point_id, e.label, e.published_at, p.available_at,
    round(list_dot_product(e.u, p.u) / (sqrt(list_dot_product(e.u, e.u)) * sqrt(list_dot_product(p.u, p.u))), 9) AS score
  FROM points e JOIN points p ON p.label = e.label)"""
ORACLE["vector_topk_join"] = f"""WITH {VECTORS},
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY score DESC, point_id) AS INTEGER) AS rank FROM pairs WHERE available_at <= published_at)
SELECT event_id, point_id, 'doc-' || point_id AS document_id, 'vector of ' || label AS text, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""
ORACLE["vector_prompt"] = f"""WITH {VECTORS},
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, point_id) AS rank FROM pairs WHERE available_at <= published_at),
ctx AS (SELECT event_id, count(*) AS n, string_agg('- [doc-' || point_id || '] score=' || format('{{:.3f}}', score) || ' available_at=' || {iso('available_at')} || ' :: vector of ' || label, chr(10) ORDER BY rank) AS lines
  FROM r WHERE rank <= 3 GROUP BY 1)
SELECT e.point_id AS event_id, CAST(coalesce(n, 0) AS INTEGER) AS n_hits,
  'event_id: ' || e.point_id || chr(10) || 'ticker: ' || label || chr(10) || 'published_at: ' || {iso('e.published_at')} || chr(10) || 'headline: h' || chr(10)
  || 'context:' || chr(10) || coalesce(lines, '(no retrieval context after as-of filter)') || chr(10) AS prompt
FROM points e LEFT JOIN ctx ON ctx.event_id = e.point_id"""
ORACLE["overfetch_topk"] = f"""WITH {VECTORS},
w AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, point_id) AS place FROM pairs),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY score DESC, point_id) AS INTEGER) AS rank FROM w WHERE place <= 15 AND available_at <= published_at)
SELECT event_id, point_id, 'doc-' || point_id AS document_id, 'vector of ' || label AS text, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""

# --- aggregations ----------------------------------------------------------

ORACLE["ingest_funnel"] = f"""WITH {ARCHIVE}
SELECT count(*) AS rows_raw, count(*) FILTER (WHERE NOT missing AND ticker IN ('A','B','N','R')) AS rows_universe,
  (SELECT count(*) FROM clean) AS rows_after_dedup, count(*) FILTER (WHERE NOT missing AND ticker NOT IN ('A','B','N','R')) AS oou_dropped,
  count(*) FILTER (WHERE missing OR (ticker IN ('A','B','N','R') AND calendar_date IS NULL)) AS missing_fields_dropped,
  count(*) FILTER (WHERE NOT missing AND alias_rule IS NOT NULL) AS alias_rows, 'ax_a_v1+nx_n_v1' AS alias_rule_version,
  (SELECT least(count(*), 200) FROM clean) AS rows_sampled FROM named"""
ORACLE["absent_tickers"] = f"""WITH {ARCHIVE}
SELECT ticker FROM (VALUES ('A'), ('B'), ('N'), ('R')) u(ticker) WHERE ticker NOT IN (SELECT ticker FROM named WHERE NOT missing)"""
ORACLE["alias_counts"] = f"""WITH {ARCHIVE}
SELECT alias_rule, version AS alias_rule_version, count(*) AS rows FROM named, (VALUES ('ax_a_v1+nx_n_v1'), ('off')) v(version)
WHERE NOT missing AND alias_rule IS NOT NULL GROUP BY 1, 2"""
ORACLE["rows_by_ticker"] = f"WITH {ARCHIVE} SELECT ticker, count(*) AS rows FROM clean GROUP BY 1"
ORACLE["class_balance"] = f"""WITH {SCORED_LABELS}, c AS (SELECT count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg FROM scored)
SELECT n_pos, n_neg, round(n_neg / n_pos::DOUBLE, 6) AS scale_pos_weight FROM c"""
ORACLE["confusion_counts"] = f"WITH {SCORED_LABELS} SELECT {CONFUSION.format(p='score >= 0.5')} FROM scored"
ORACLE["prf1"] = f"""WITH {SCORED_ORDERS}, c AS (SELECT CAST(year(published_at) AS INTEGER) AS year, {CONFUSION.format(p='score >= 0.6')} FROM scored GROUP BY 1),
m AS (SELECT *, {PRF} FROM c) SELECT year, tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round({F1}, 6) AS f1 FROM m"""

GRID = """grid AS (SELECT CAST(i + 1 AS INTEGER) AS step, CASE WHEN i = 18 THEN 0.95::DOUBLE ELSE i * ((0.95::DOUBLE - 0.05::DOUBLE) / 18) + 0.05::DOUBLE END AS threshold FROM range(19) t(i)),
c AS (SELECT step, threshold, """ + CONFUSION.format(p="score >= threshold") + """ FROM grid, scored GROUP BY 1, 2),
m AS (SELECT *, """ + PRF + " FROM c)"
ORACLE["threshold_f1"] = f"""WITH {SCORED_ORDERS}, {GRID}
SELECT step, round(threshold, 6) AS threshold, tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round({F1}, 6) AS f1 FROM m"""
ORACLE["best_threshold"] = f"""WITH {SCORED_LABELS}, {GRID}
SELECT round(threshold, 6) AS threshold, round({F1}, 6) AS f1, tp, fp, tn, fn FROM m ORDER BY {F1} DESC, threshold LIMIT 1"""

SPLIT = RANKED_ORDERS + f""", c AS (SELECT split, count(*) AS rows, {CONFUSION.format(p='score >= 0.55')} FROM split GROUP BY 1), m AS (SELECT *, {PRF} FROM c)"""
ORACLE["split_metrics"] = f"WITH {SPLIT} SELECT split, rows, tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round({F1}, 6) AS f1 FROM m"
ORACLE["f1_gap"] = f"""WITH {SPLIT}, g AS (SELECT max({F1}) FILTER (WHERE split = 'train') AS a, max({F1}) FILTER (WHERE split = 'test') AS b FROM m)
SELECT round(a, 6) AS train_f1, round(b, 6) AS test_f1, round(abs(a - b), 6) AS f1_gap, abs(a - b) > 0.25 AS large_gap FROM g"""

_LOSS = "avg(CASE WHEN label = 1 THEN -ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, score))) ELSE -ln(1 - greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, score))) END)"
ORACLE["log_loss"] = f"WITH {SCORED_ORDERS} SELECT CAST(year(published_at) AS INTEGER) AS year, round({_LOSS}, 6) AS log_loss, count(*) AS rows FROM scored GROUP BY 1"
ORACLE["pick_winner"] = f"""WITH {SCORED_ORDERS}, g AS (
  SELECT CAST(year(published_at) AS INTEGER) AS max_depth, quarter(published_at) / 10.0::DOUBLE AS step_size, CAST(day(published_at) AS INTEGER) AS rounds, {_LOSS} AS loss FROM scored GROUP BY ALL)
SELECT max_depth, step_size, rounds, round(loss, 6) AS mean_log_loss FROM g ORDER BY loss, max_depth, step_size, rounds LIMIT 1"""

ORACLE["dataset_fingerprint"] = """WITH d AS (SELECT sha256(concat(length(o_orderkey::VARCHAR), ':', o_orderkey, length(o_custkey::VARCHAR), ':', o_custkey,
  length(o_orderstatus), ':', o_orderstatus, length(o_orderpriority), ':', o_orderpriority)) AS h FROM orders),
l AS (SELECT CAST('0x' || substr(h, 1, 15) AS BIGINT) AS a, CAST('0x' || substr(h, 16, 15) AS BIGINT) AS b, CAST('0x' || substr(h, 31, 15) AS HUGEINT) AS c FROM d)
SELECT count(*) AS rows, bit_xor(a) AS xor_a, bit_xor(b) AS xor_b, CAST(sum(c) AS VARCHAR) AS sum_c FROM l"""

ORACLE["label_rate"] = f"""WITH {TRAINING}
SELECT ticker, count(*) AS rows, count(*) FILTER (WHERE label_high_risk = 1) AS positive, round(avg(label_high_risk), 6) AS label_rate,
  round(min({sentiment('headline')}), 6) AS sentiment_min, round(max({sentiment('headline')}), 6) AS sentiment_max
FROM featured WHERE {COMPLETE} GROUP BY 1"""
ORACLE["label_rate_by_ticker"] = f"""WITH {TRAINING}
SELECT ticker, count(*) AS events, count(volatility_20d) AS with_volatility, count(label_high_risk) AS labelled, round(avg(label_high_risk), 6) AS label_rate
FROM featured GROUP BY 1"""

ORACLE["feed_summary"] = f"WITH {FEEDS} {feed_totals(6, 'ticker')}"
ORACLE["feed_to_events"] = f"WITH {FEEDS} {feed_totals(5, '')}"
ORACLE["feed_micro_batch"] = f"WITH {FEEDS}, t AS ({feed_totals(10, 'ticker')}) SELECT ticker, fetched, produced, skipped_items, cut_items, errors FROM t"

# --- windows, sorts, sets --------------------------------------------------

for _name in ("return_5d_prior", "return_20d_prior", "spy_return_5d", "fwd_return_5d", "volatility_20d"):
    ORACLE[_name] = f"WITH {PRICED} SELECT ticker, session_idx, session_date, round({_name}, 6) AS {_name} FROM features"

ORACLE["dedup_first"] = f"WITH {ARCHIVE} SELECT row_order, ticker, calendar_date, sha256(normalized) AS headline_digest FROM clean"
ORACLE["stratified_sample"] = f"WITH {ARCHIVE}, {sampled(200, 42)} SELECT event_id, ticker, row_order FROM sampled"
ORACLE["union_parts"] = f"WITH {ARCHIVE}, {sampled(150, 7)} SELECT ticker, count(*) AS rows FROM sampled GROUP BY 1"
ORACLE["remainder"] = f"WITH {ARCHIVE}, {sampled(200, 42)} SELECT event_id, ticker FROM turned WHERE turn > 200"
_TRAIN_ID = uuid5("'hindcast:train:' || ticker || ':' || strftime(calendar_date, '%Y-%m-%d') || ':' || substr(sha256(normalized), 1, 16)")
ORACLE["train_event_id"] = f"WITH {ARCHIVE} SELECT row_order, {_TRAIN_ID} AS event_id FROM named WHERE NOT missing AND calendar_date IS NOT NULL"
ORACLE["unique_event_ids"] = f"""WITH {ARCHIVE}, i AS (SELECT {_TRAIN_ID} AS event_id FROM named WHERE NOT missing AND calendar_date IS NOT NULL)
SELECT event_id, count(*) AS copies FROM i GROUP BY 1 HAVING count(*) > 1"""

ORACLE["time_rank"] = f"WITH {RANKED_ORDERS} SELECT event_id, published_at, time_rank FROM ranked"
ORACLE["time_split"] = f"""WITH {RANKED_ORDERS} SELECT split, count(*) AS rows, min(published_at) AS "first", max(published_at) AS "last" FROM split GROUP BY 1"""
ORACLE["time_folds"] = f"""WITH {RANKED_ORDERS}, t AS (SELECT *, count(*) OVER () AS m FROM split WHERE split = 'train'),
f AS (SELECT t.*, fold, m - 3 * (m // 4) + (fold - 1) * (m // 4) AS start, m // 4 AS size FROM t, (VALUES (1), (2), (3)) v(fold)),
r AS (SELECT *, CASE WHEN time_rank <= start THEN 'train' WHEN time_rank <= start + size THEN 'validate' END AS role FROM f)
SELECT fold, role, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positive, min(time_rank) AS first_rank, max(time_rank) AS last_rank
FROM r WHERE role IS NOT NULL GROUP BY 1, 2"""
ORACLE["global_rank"] = """SELECT o_orderstatus, o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_orderkey) AS rank FROM orders"""
ORACLE["topk_hits"] = f"WITH {SEEN} SELECT event_id, document_id, score, rank FROM ranked WHERE rank <= 3"
ORACLE["newest_items"] = f"""WITH {FEEDS}
SELECT d.document, CAST(CASE WHEN empty_channel THEN 0 ELSE n_good END AS INTEGER) AS n_items, coalesce(string_agg(headline, '|' ORDER BY pos) FILTER (WHERE pos <= 3), '') AS kept
FROM docs d LEFT JOIN kept USING (document) WHERE d.error IS NULL GROUP BY ALL"""
ORACLE["sort_by_time"] = f"""WITH {RANKED_ORDERS}
SELECT CAST(year(published_at) AS INTEGER) AS year, arg_min(event_id, time_rank) AS first_id, arg_max(event_id, time_rank) AS last_id FROM ranked GROUP BY 1"""
ORACLE["distinct_days"] = """SELECT CAST(o_orderdate AS DATE) AS day FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem"""

# --- scalar functions ------------------------------------------------------

ORACLE["normalize_headline"] = f"SELECT doc_id, {norm('text')} AS normalized FROM documents"
ORACLE["source_row_hash"] = f"WITH {ARCHIVE} SELECT row_order, sha256(concat_ws('|', date, stock, headline)) AS source_row_hash FROM named WHERE NOT missing"
ORACLE["uuid5"] = f"SELECT conv_id, turn, {uuid5('concat_ws(chr(58), role, text)')} AS id FROM conversations"
ORACLE["event_point_id"] = f"WITH {EVENTS} SELECT event_id, {_POINT} AS point_id FROM news"
ORACLE["rss_event_id"] = f"""SELECT page_id, {uuid5("'hindcast:rss:AAPL:' || url")} AS event_id FROM pages"""
ORACLE["rss_item_key"] = f"""WITH {EVENTS}
SELECT event_id, CASE WHEN k % 3 = 1 THEN 'g-' || event_id WHEN k % 2 = 0 THEN 'https://example.org/' || event_id
  ELSE substr(sha256(headline || '|' || {iso('published_at')}), 1, 32) END AS item_key FROM news"""
ORACLE["parse_rss_date"] = f"""WITH {EVENTS}
SELECT event_id, CASE k % 7 WHEN 0 THEN published_at WHEN 1 THEN published_at + INTERVAL 5 HOUR WHEN 2 THEN published_at - INTERVAL '1 hour 30 minutes'
  WHEN 3 THEN published_at WHEN 4 THEN published_at + INTERVAL 5 HOUR END AS published_at FROM news"""
ORACLE["parse_published_at"] = f"WITH {ARCHIVE} SELECT row_order, parsed_at AS published_at FROM spelled"
ORACLE["parse_calendar_date"] = f"WITH {ARCHIVE} SELECT row_order, calendar_date FROM spelled"
ORACLE["published_at"] = f"WITH {ARCHIVE} SELECT row_order, published_at FROM named"
ORACLE["open_stamp"] = """SELECT o_orderkey, ((o_orderdate + INTERVAL '9 hours 30 minutes') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS open_at FROM orders"""
ORACLE["simple_return"] = """WITH r AS (SELECT l_returnflag, l_linestatus, l_tax / nullif(l_discount, 0) - 1 AS v FROM lineitem)
SELECT l_returnflag, l_linestatus, count(v) AS n, round(min(v), 6) AS lowest, round(max(v), 6) AS highest FROM r GROUP BY 1, 2"""
ORACLE["label_high_risk"] = f"WITH {PRICED} SELECT ticker, session_date, CAST(fwd_return_5d < -0.03 AS INTEGER) AS label_high_risk FROM features"
ORACLE["sentiment_from_probs"] = """SELECT l_shipdate, round(min(l_discount - l_tax), 6) AS low, round(max(l_discount - l_tax), 6) AS high, count(*) AS n FROM lineitem GROUP BY 1"""
ORACLE["clamp_score"] = "SELECT event_id, round(greatest(0.0, least(1.0, value / 50 - 0.1)), 6) AS score FROM events"

POLICY = """rows AS (
  SELECT event_id, CASE WHEN event_id % 17 = 3 THEN 'SELL' WHEN event_id % 17 = 9 THEN NULL WHEN event_type = 'view' THEN 'HOLD' WHEN event_type = 'error' THEN 'PASS' ELSE 'BUY' END AS action,
    CASE WHEN event_id % 10 = 0 THEN 0.45 ELSE value / 100 END AS score,
    CASE WHEN event_id % 20 = 1 THEN 14.0 WHEN event_id % 20 = 7 THEN NULL ELSE user_id / 16.0::DOUBLE END AS vol FROM events),
capped AS (SELECT *, {score} AS s FROM rows),
verdicts AS (
  SELECT *, CASE WHEN action IN ('HOLD', 'PASS') THEN 'approve' WHEN action IS NULL OR action <> 'BUY' THEN NULL WHEN s >= 0.45 OR vol >= 14.0 THEN 'reject' WHEN vol IS NOT NULL THEN 'approve' END AS decision,
    CASE WHEN action IN ('HOLD', 'PASS') THEN action || ' always approve under policy_version=v1' WHEN action IS NULL OR action <> 'BUY' THEN NULL
      WHEN s >= 0.45 THEN printf('BUY rejected: downside_risk_score=%.4f >= score_threshold=%.4f', s, 0.45::DOUBLE)
      WHEN vol >= 14.0 THEN printf('BUY rejected by vol veto: volatility_20d=%.4f >= vol_veto_threshold=%.4f', vol, 14.0::DOUBLE)
      WHEN vol IS NOT NULL THEN printf('BUY approved: downside_risk_score=%.4f < score_threshold=%.4f', s, 0.45::DOUBLE) END AS reason FROM capped)"""
ORACLE["gate_policy"] = f"WITH {POLICY.format(score='score')} SELECT event_id, decision, reason FROM verdicts"
ORACLE["decide"] = f"""WITH {POLICY.format(score='greatest(0.0, least(1.0, score))')}
SELECT event_id, action, round(s, 6) AS downside_risk_score, decision, reason AS decision_reason, 'view-1' AS model_version, 'view-bundle' AS bundle_id,
  'finbert_sentiment,volatility_20d,return_5d_prior,return_20d_prior,spy_return_5d' AS features_used, 'v1' AS policy_version FROM verdicts"""

ORACLE["parse_proposal"] = f"WITH {ANSWERS} SELECT id, action, round(confidence, 6) AS confidence, proposed_event_id, proposed_ticker, errors FROM checked"
ORACLE["repair_route"] = f"""WITH {ANSWERS}
SELECT id, CASE WHEN errors = '' THEN 'ok' WHEN id % 3 >= 1 THEN 'fail' ELSE 'retry' END AS route FROM checked"""
ORACLE["context_prompt"] = f"""WITH {SEEN},
ctx AS (SELECT event_id, count(*) AS n, string_agg('- [' || document_id || '] score=' || format('{{:.3f}}', score) || ' available_at=' || {iso('available_at')} || ' :: ' || text, chr(10) ORDER BY rank) AS lines
  FROM ranked WHERE rank <= 5 GROUP BY 1)
SELECT e.event_id, CAST(coalesce(n, 0) AS INTEGER) AS n_hits,
  'event_id: ' || e.event_id || chr(10) || 'ticker: ' || ticker || chr(10) || 'published_at: ' || {iso('e.published_at')} || chr(10) || 'headline: ' || headline || chr(10)
  || 'context:' || chr(10) || coalesce(lines, '(no retrieval context after as-of filter)') || chr(10)
  || CASE WHEN k % 4 = 0 THEN chr(10) || 'Previous output was invalid: bad action ' || ticker || chr(10) || 'Fix and return valid JSON only.' || chr(10) ELSE '' END AS prompt
FROM news e LEFT JOIN ctx USING (event_id)"""
ORACLE["encode_payload"] = f"""WITH {EVENTS}, e AS (SELECT event_id, headline, ticker, source, {iso('published_at')} AS published_at,
  CASE WHEN k % 2 = 0 THEN 'https://example.org/' || event_id END AS url FROM news)
SELECT event_id, {_GOOD.format(ver="'1'", url='url')} AS value FROM e"""
ORACLE["decode_payload"] = f"""WITH {PAYLOADS}
SELECT id, reason, CASE WHEN reason IS NULL THEN event_id END AS event_id, CASE WHEN reason IS NULL THEN trim(headline) END AS headline,
  CASE WHEN reason IS NULL THEN upper(trim(ticker)) END AS ticker, CASE WHEN reason IS NULL THEN source END AS source,
  CASE WHEN reason IS NULL THEN url END AS url, CASE WHEN reason IS NULL THEN {GOOD_CLOCK} END AS published_at FROM decoded"""
ORACLE["embed_unit"] = """WITH p AS (SELECT vec_id AS point_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT point_id, CAST(len(v) AS INTEGER) AS size, 1.0::DOUBLE AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS "first" FROM p"""
ORACLE["embed_text"] = """SELECT doc_id, 384 AS size, CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}]') THEN 1.0 ELSE 0.0 END::DOUBLE AS cosine FROM documents"""

# --- streaming -------------------------------------------------------------

ORACLE["stream_ingest"] = f"""WITH {PAYLOADS}
SELECT {_POINT} AS point_id, event_id AS document_id, trim(headline) AS text, upper(trim(ticker)) AS ticker, {GOOD_CLOCK} AS available_at
FROM decoded WHERE reason IS NULL"""
ORACLE["poison_to_dlq"] = f"""WITH {PAYLOADS}
SELECT reason, 2 * count(*) AS records, count(DISTINCT id) AS offsets FROM decoded WHERE reason IS NOT NULL GROUP BY 1"""

ORACLE["idempotent_redelivery"] = f"""WITH {PAYLOADS}
SELECT upper(trim(ticker)) AS ticker, 2 * count(*) AS deliveries, count(*) AS points FROM decoded WHERE reason IS NULL GROUP BY 1"""
ORACLE["stop_on_failure"] = f"""WITH {PAYLOADS}
SELECT upper(trim(ticker)) AS ticker, count(*) AS points, true AS failed_once FROM decoded WHERE reason IS NULL GROUP BY 1"""

ORACLE["restart_new_checkpoint"] = f"""WITH {PAYLOADS}
SELECT 'points' AS "table", count(*) AS records FROM decoded WHERE reason IS NULL
UNION ALL SELECT 'dead letters', count(*) FROM decoded WHERE reason IS NOT NULL"""
ORACLE["at_least_once"] = f"""WITH {PAYLOADS},
e AS (SELECT event_id, count(*) AS copies FROM decoded WHERE reason IS NULL GROUP BY 1) SELECT copies, count(*) AS events FROM e GROUP BY 1"""

# --- training --------------------------------------------------------------

STUMP = """rows AS (
  SELECT o_orderkey AS event_id, CAST(o_orderstatus = 'F' AND o_totalprice > 150000 AS INTEGER) AS label, floor(o_totalprice / 100000) AS x FROM orders),
weighed AS (SELECT *, CASE WHEN label = 1 THEN (SELECT count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1)::DOUBLE FROM rows) ELSE 1.0 END AS w FROM rows),
sums AS (SELECT x, sum(w) AS sw, sum(w * (2 * label - 1)) AS sy FROM weighed GROUP BY x),
cuts AS (
  SELECT c.x AS cut, sum(s.sw) FILTER (WHERE s.x <= c.x) AS lw, sum(s.sy) FILTER (WHERE s.x <= c.x) AS ly,
    sum(s.sw) FILTER (WHERE s.x > c.x) AS rw, sum(s.sy) FILTER (WHERE s.x > c.x) AS ry FROM sums c, sums s GROUP BY c.x),
best AS (SELECT * FROM cuts WHERE rw IS NOT NULL ORDER BY ly * ly / lw + ry * ry / rw DESC, cut LIMIT 1),
scored AS (SELECT event_id, label, 1 / (1 + exp(-2 * CASE WHEN x <= cut THEN ly / lw ELSE ry / rw END)) AS score FROM weighed, best)"""
ORACLE["fit_gate_model"] = f"WITH {STUMP} SELECT event_id, label AS label_high_risk, round(score, 6) AS score FROM scored"
ORACLE["score_gate"] = f"WITH {STUMP} SELECT event_id, round(score, 6) AS score, score >= 0.5 AS high FROM scored"
GRID_POINTS = len(GRID_DEPTH) * len(GRID_STEP) * len(GRID_ROUNDS)
ORACLE["hpo_tree_grid"] = f"""WITH {TRAINING}, t AS (SELECT count(*) AS n FROM featured WHERE {COMPLETE})
SELECT CAST(f + 1 AS INTEGER) AS fold, {GRID_POINTS} AS losses, true AS means_hold, true AS by_rule FROM t, range({TIME_FOLDS}) r(f) WHERE n > 0"""
ORACLE["train_gate_trees"] = f"""WITH {TRAINING}, ranked AS (
  SELECT label_high_risk AS label, row_number() OVER (ORDER BY published_at, event_id) AS r, count(*) OVER () AS n FROM featured WHERE {COMPLETE})
SELECT CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split, count(*) AS rows, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives
FROM ranked GROUP BY 1"""

def second_order(n_cuts: list[int], depth: int, step: float, rounds: int, src: str, tag: str) -> str:
    """Boosting stated level by level. `src`: k (which fit), train, label, w and bins b0, b1, ...; {tag}t: margins m after t trees."""
    bins = ", ".join(f"b{i}" for i in range(len(n_cuts)))
    pairs = ", ".join(f"{{'f': {i}, 'b': b{i}}}" for i in range(len(n_cuts)))
    parts = [f"{tag}0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS m FROM {src})"]
    for t in range(rounds):
        p, n = "1 / (1 + exp(-m))", f"{tag}{t}n"
        parts.append(f"{n}0 AS MATERIALIZED (SELECT *, w * ({p} - label) AS g, w * ({p}) * (1 - {p}) AS h, 1 AS node FROM {tag}{t})")
        for d in range(depth):
            parts += [
                f"{n}{d}h AS (SELECT k, node, u.f AS f, u.b AS b, sum(g) AS g, sum(h) AS h FROM (SELECT k, node, g, h, unnest([{pairs}]) AS u FROM {n}{d} WHERE train) GROUP BY ALL)",
                f"{n}{d}c AS (SELECT *, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(g) OVER a AS gt, sum(h) OVER a AS ht FROM {n}{d}h WINDOW u AS (PARTITION BY k, node, f ORDER BY b), a AS (PARTITION BY k, node, f))",
                f"{n}{d}g AS (SELECT *, round(gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1), 9) AS gain FROM {n}{d}c WHERE b < {n_cuts}[f + 1] AND hl >= 1 AND ht - hl >= 1)",
                f"{n}{d}s AS MATERIALIZED (SELECT k, node, f, b FROM {n}{d}g WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY k, node ORDER BY gain DESC, f, b) = 1)",
                f"{n}{d + 1} AS MATERIALIZED (SELECT x.* REPLACE (CASE WHEN s.f IS NULL THEN x.node WHEN [{bins}][s.f + 1] <= s.b THEN 2 * x.node ELSE 2 * x.node + 1 END AS node) FROM {n}{d} x LEFT JOIN {n}{d}s s ON s.k = x.k AND s.node = x.node)".replace(f"[{bins}]", "[" + ", ".join(f"x.b{i}" for i in range(len(n_cuts))) + "]"),
            ]
        parts.append(f"{n}w AS MATERIALIZED (SELECT k, node, -sum(g) / (sum(h) + 1) AS leaf FROM {n}{depth} WHERE train GROUP BY ALL)")
        parts.append(f"{tag}{t + 1} AS MATERIALIZED (SELECT x.* EXCLUDE (g, h, node) REPLACE (x.m + {step} * leaf AS m) FROM {n}{depth} x JOIN {n}w l ON l.k = x.k AND l.node = x.node)")
    return ", ".join(parts)


def _bin(value: str, cuts: tuple) -> str:
    return f"len(list_filter({list(cuts)}, lambda c: c < {value}))"


GATE_CUTS = ((0, 1, 2, 3, 4, 5, 6), (3, 6, 9), (0, 2, 4, 6, 8))
GATE_N = [len(c) for c in GATE_CUTS]
GATE = f"""gate AS (
  SELECT o_orderkey AS event_id, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS published_at,
    CAST((o_orderstatus = 'F' AND o_totalprice > 150000) OR o_custkey % 11 = 0 AS INTEGER) AS label,
    {_bin('floor(o_totalprice / 50000)', GATE_CUTS[0])} AS b0, {_bin('month(o_orderdate)', GATE_CUTS[1])} AS b1, {_bin('o_custkey % 11', GATE_CUTS[2])} AS b2 FROM orders),
gated AS (SELECT *, row_number() OVER (ORDER BY published_at, event_id) AS time_rank, CAST(floor(count(*) OVER () * 0.8) AS BIGINT) AS m FROM gate)"""
ORACLE["fit_second_order"] = f"""WITH {GATE}, src AS (SELECT event_id, label, CASE WHEN label = 1 THEN 3.0 ELSE 1.0 END AS w, b0, b1, b2, 1 AS k, true AS train FROM gated),
{second_order(GATE_N, 2, 0.3, 2, 'src', 'a')} SELECT event_id, label AS label_high_risk, round(1 / (1 + exp(-m)), 6) AS score FROM a2"""
_NEAR = "-ln(greatest(1e-15, least(1 - 1e-15, CASE WHEN label = 1 THEN 1 / (1 + exp(-m)) ELSE 1 - 1 / (1 + exp(-m)) END)))"
ORACLE["hpo_time_grid"] = f"""WITH {GATE}, src AS (
  SELECT fold AS k, gated.*, m - 3 * (m // 4) + (fold - 1) * (m // 4) AS start, m - 3 * (m // 4) + fold * (m // 4) AS stop, CASE WHEN label = 1 THEN 3.0 ELSE 1.0 END AS w
  FROM gated, (VALUES (1), (2), (3)) v(fold) WHERE time_rank <= m),
folded AS (SELECT * EXCLUDE (m), time_rank <= start AS train FROM src WHERE time_rank <= stop),
{second_order(GATE_N, 1, 0.3, 3, 'folded', 'a')}, {second_order(GATE_N, 2, 0.3, 3, 'folded', 'c')},
points AS ({' UNION ALL '.join(f"SELECT {d} AS max_depth, {r} AS rounds, k, start, stop, train, label, m FROM {t}{r}" for d, t in ((1, 'a'), (2, 'c')) for r in (1, 3))}),
losses AS (SELECT max_depth, 0.3::DOUBLE AS step_size, rounds, CAST(k AS INTEGER) AS fold, start AS last_train_rank, stop AS last_rank, avg({_NEAR}) AS log_loss FROM points WHERE NOT train GROUP BY ALL),
means AS (SELECT *, avg(log_loss) OVER (PARTITION BY max_depth, rounds) AS mean_log_loss FROM losses)
SELECT max_depth, step_size, rounds, fold, last_train_rank, last_rank, round(log_loss, 6) AS log_loss, round(mean_log_loss, 6) AS mean_log_loss,
  dense_rank() OVER (ORDER BY mean_log_loss, max_depth, rounds) = 1 AS wins FROM means"""
ORACLE["train_gate"] = f"""WITH {GATE}, src AS (
  SELECT event_id, label, b0, b1, b2, 1 AS k, time_rank <= m AS train,
    CASE WHEN label = 1 THEN count(*) FILTER (label = 0 AND time_rank <= m) OVER () / (count(*) FILTER (label = 1 AND time_rank <= m) OVER ())::DOUBLE ELSE 1.0 END AS w FROM gated),
{second_order(GATE_N, 2, 0.3, 2, 'src', 'a')}, scores AS (SELECT *, 1 / (1 + exp(-m)) AS score FROM a2),
grid AS (SELECT unnest(range(1, 20)) * 5 / 100.0::DOUBLE AS threshold),
tried AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp, count(*) FILTER (WHERE score < threshold AND label = 1) AS fn FROM scores, grid WHERE train GROUP BY 1),
best AS (SELECT threshold FROM tried ORDER BY CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END DESC, threshold LIMIT 1),
c AS (SELECT CASE WHEN train THEN 'train' ELSE 'test' END AS split, count(*) AS rows, threshold, {CONFUSION.format(p='score >= threshold')} FROM scores, best GROUP BY ALL),
x AS (SELECT *, {PRF} FROM c)
SELECT split, rows, tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round({F1}, 6) AS f1, round(threshold, 6) AS threshold FROM x"""
ORACLE["join_hits_asof_ticker"] = f"""WITH {EVENTS}, {HITS},
placed AS (SELECT ticker, document_id, row_number() OVER (PARTITION BY ticker ORDER BY available_at, document_id DESC) AS place FROM hits),
line AS (SELECT ticker, available_at AS clock, 0 AS kind, NULL AS event_id FROM hits UNION ALL SELECT ticker, published_at, 1, event_id FROM news),
seen AS (SELECT *, count(*) FILTER (WHERE kind = 0) OVER (PARTITION BY ticker ORDER BY clock, kind) AS n FROM line),
counted AS (SELECT * FROM seen WHERE kind = 1)
SELECT c.event_id, c.n AS n_visible, coalesce(string_agg(document_id, ',' ORDER BY place DESC), '') AS newest
FROM counted c LEFT JOIN placed p ON p.ticker = c.ticker AND p.place IN (c.n, c.n - 1, c.n - 2) GROUP BY ALL"""
ORACLE["attempts_to_dlq"] = f"""WITH {PAYLOADS}, r AS (SELECT upper(trim(ticker)) AS ticker, contains(headline, 'user 3') AS bad FROM decoded WHERE reason IS NULL)
SELECT ticker, count(*) FILTER (WHERE NOT bad) AS points, count(*) FILTER (WHERE bad) AS refused, CAST(CASE WHEN bool_or(bad) THEN 3 ELSE 0 END AS INTEGER) AS attempts FROM r GROUP BY 1"""
ORACLE["sink_snapshot"] = f"WITH {EVENTS} SELECT ticker, count(*) AS events, max(published_at) AS last, true AS failed_once FROM news GROUP BY 1"
ORACLE["redelivery_watermark"] = ORACLE["idempotent_redelivery"]
ORACLE["scan_closes_partitioned"] = f"WITH {CLOSES} SELECT ticker, session_date, round(close, 6) AS close FROM closes WHERE ticker IN ('A', 'R')"
ORACLE["envelope_extras"] = f"""WITH {EVENTS} SELECT event_id, 'success' AS status, CASE WHEN k % 7 > 2 THEN k % 5 END AS shard,
  CASE WHEN k % 7 > 2 THEN 'w' || (k % 3) END AS name, CASE WHEN k % 7 > 2 THEN 'b' || (k % 4) END AS tag, CAST(NULL AS BIGINT) AS no_number FROM news"""
ORACLE["vector_topk_cells"] = ORACLE["vector_topk_join"]
ORACLE["dedup_first_csv"] = f"WITH {ARCHIVE} SELECT date, stock, ticker, calendar_date, sha256(normalized) AS headline_digest FROM clean"

# --- end to end ------------------------------------------------------------


def archive_training(events: str, steps: str) -> str:
    picked = f"picked AS (SELECT event_id, headline, ticker, published_at, source_row_hash FROM {events})"
    return f"""WITH {ARCHIVE}, {steps}{picked}, {PRICED}, {dated('picked')}, {FEATURED}
{TRAINING_SELECT}, 'test-documents' AS source_dataset_id, source_row_hash, '1' AS builder_version FROM featured WHERE {COMPLETE}"""


ORACLE["build_training_events"] = archive_training("sampled", sampled(200, 42) + ", ")
ORACLE["build_training_events_full"] = archive_training("clean", "")
ORACLE["build_counts"] = f"""WITH {ARCHIVE}, picked AS (SELECT event_id, headline, ticker, published_at, source_row_hash FROM clean), {PRICED}, {dated('picked')}, {FEATURED},
f AS (SELECT *, volatility_20d IS NOT NULL AND return_5d_prior IS NOT NULL AND return_20d_prior IS NOT NULL AND spy_return_5d IS NOT NULL AS ok FROM featured)
SELECT count(*) AS rows_sampled, count(*) FILTER (WHERE NOT ok) AS dropped_features,
  count(*) FILTER (WHERE ok AND fwd_return_5d IS NULL) AS dropped_label, count(*) FILTER (WHERE ok AND fwd_return_5d IS NOT NULL) AS rows FROM f"""
ORACLE["expectation_suite"] = f"""WITH {CASES} SELECT case_id, "check", expected, actual, passed FROM judged"""
ORACLE["suite_counts"] = f"""WITH {CASES} SELECT "check", count(*) AS cases, count(*) FILTER (WHERE passed) AS passed FROM judged GROUP BY 1"""
