"""The catalogue's queries as SQL for DuckDB, on the same tables."""

from __future__ import annotations

from ..functions.text import FORMS

PUBLICATIONS = """SELECT o_orderstatus AS source, o_orderpriority AS query, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
    CAST(count(*) AS INTEGER) AS count FROM orders GROUP BY ALL"""
SALES = """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus AS segment, c_mktsegment AS category, sum(o_totalprice) AS value
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""
VISITORS = """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus AS segment, count(DISTINCT o_custkey) AS visitors FROM orders GROUP BY ALL"""
PRODUCTS = """SELECT 's' || (p_partkey % 4) AS source, CAST(p_partkey AS VARCHAR) AS product_key, p_brand AS brand,
    '[' || p_type || '] ' || p_name || ' ' || p_size || 'ml' || CASE WHEN p_partkey % 7 = 0 THEN ' (a/b/c)' ELSE '' END
    || CASE WHEN p_partkey % 11 = 0 THEN ' 3 colors' ELSE '' END AS name FROM part"""
PRICES = """SELECT 's' || (l_partkey % 4) AS source, CAST(l_partkey AS VARCHAR) AS product_key, CAST(l_shipdate AS DATE) AS captured_at,
    round(l_extendedprice / l_quantity, 2) AS price, l_discount AS discount_rate FROM lineitem"""
RANKS = """SELECT source, board, captured_at, product_key, price, discount_rate,
    CAST(row_number() OVER (PARTITION BY source, board, captured_at ORDER BY round(sales, 2) DESC, product_key) AS INTEGER) AS rank
    FROM (SELECT l_linestatus AS source, l_returnflag AS board, CAST(date_trunc('month', l_shipdate) AS DATE) AS captured_at, l_partkey AS product_key,
          sum(l_extendedprice) AS sales, max(l_discount) AS discount_rate, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL)"""
NEW = f"""SELECT f.source, f.product_key, p.name, p.brand, f.captured_at FROM (
    SELECT source, product_key, min(captured_at) AS captured_at FROM ({PRICES}) GROUP BY ALL) f JOIN ({PRODUCTS}) p USING (source, product_key)"""
REVIEWS = """SELECT 's' || (doc_id % 4) AS source, CAST(doc_id AS VARCHAR) AS product_key, quality AS rating, CAST(ts AS DATE) AS written_at, text AS body
    FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN events ON event_id = doc_id"""
TOPICS = """SELECT 's' || (g % 4) AS source, CAST(g AS VARCHAR) AS product_key, event_type AS topic_name, event_type <> 'error' AS is_positive, n AS review_count,
    CASE WHEN event_type <> 'error' THEN round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY g), 2) END AS share_pct
    FROM (SELECT user_id % (SELECT count(*) FROM part) AS g, event_type, count(*) AS n FROM events GROUP BY ALL)"""
LABELLED = """SELECT doc_id AS pair_id, CASE WHEN quality = 1 THEN 'y' WHEN quality = 0 THEN ' N ' WHEN doc_id % 17 = 0 THEN '?' END AS is_same_product,
    0.45::DOUBLE + (doc_id % 155) / 100.0::DOUBLE AS score FROM documents LEFT JOIN labels USING (doc_id)"""
ANSWERED = f"SELECT *, trim(lower(is_same_product)) = 'y' AS correct FROM ({LABELLED}) WHERE trim(lower(is_same_product)) IN ('y', 'n')"

#: Names in Korean, one for each part by its key: brackets, promotions, volumes, forms, colours, lists.
KOREAN = [
    "[1+1] 라운드랩 독도 토너 200ml 기획", "닥터지 레드 블레미쉬 클리어 수딩 크림 50mL", "(단독) 려 루트젠 샴푸 353ml 본품+리필", "클리오 킬커버 쿠션 2 호 택1",
    "메디힐 마스크팩 (티트리/비타민/콜라겐) 10매", "롬앤 쥬시 래스팅 틴트 8가지", "AHC 선 스틱 14g 한정 세트", "어노브 트리트먼트 320ml (모이스처,웜페탈,화이트머스크) 증정", "이니스프리 노세범 파우더 5g 3종", "【특가】 설화수 앰플 2 + 1 60캡슐",
]
END = r"([^\p{L}\p{N}_]|$)"
VOLUME = rf"(\d+(?:\.\d+)?)\s*(ml|mL|ML|g|G|호|매|개|정|캡슐|포){END}"
PROMO = r"(기획|한정|단독|증정|사은품|리필|본품|세트|특가|할인|무료배송|택1|\d+\s*\+\s*\d+)"


def norm(name: str) -> str:
    out = f"coalesce({name}, '')"
    for pattern in (r"[\[\(【][^\]\)】]*[\]\)】]", PROMO, VOLUME, r"[^0-9A-Za-z가-힣]+", r"\s+"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return f"lower(trim({out}))"


def variants(name: str) -> str:
    return rf"""coalesce(list_filter(list_transform(list_filter(range(1, length({name}) + 1), lambda k: substr({name}, CAST(k AS INTEGER), 1) IN ('(', '（')),
        lambda k: list_filter(list_transform(regexp_split_to_array(regexp_replace(substr({name}, CAST(k AS INTEGER) + 1), '[\)）]\s*$', ''), '[/,]'), lambda p: trim(p, ' ()（）')), lambda p: p <> '')),
        lambda l: len(l) >= 3)[1], [])"""


def kind(name: str) -> str:
    return rf"CASE WHEN regexp_matches({name}, '[0-9]+\s*종|[0-9]+\s*[Cc]olors?|[0-9]+\s*가지|[0-9]+\s*호|택\s*[0-9]') OR len({variants(name)}) > 0 THEN 'listing' ELSE 'sku' END"


def form(name: str) -> str:
    """The forms with words in Latin letters; the names of the fixtures have no others."""
    tight = f"replace(lower({name}), ' ', '')"
    return f"CASE WHEN contains({tight}, 'sun') THEN 'sun' WHEN contains({tight}, 'edp') OR contains({tight}, 'edt') THEN 'perfume' ELSE '' END"


def any_form(name: str) -> str:
    """All forms, in their order."""
    tight = f"replace(lower({name}), ' ', '')"
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({tight}, {w!r})' for w in words)} THEN '{form}'" for form, words in FORMS) + " ELSE '' END"


FEATURES = f"""SELECT * FROM (SELECT source, product_key, name, brand, lower(regexp_replace(brand, '[^0-9A-Za-z가-힣]+', '', 'g')) AS brand_norm, {norm("name")} AS norm,
    try_cast(nullif(regexp_extract(name, '{VOLUME}', 1), '') AS DOUBLE) AS amount, lower(regexp_extract(name, '{VOLUME}', 2)) AS unit, {form("name")} AS form FROM ({PRODUCTS})) WHERE length(norm) > 1"""
GRAMS = """SELECT norm, substr(w, CAST(k AS INTEGER), CAST(n AS INTEGER)) AS gram, count(*) AS tf FROM (
    SELECT norm, w, n, unnest(range(1, length(w) - n + 2)) AS k FROM (
        SELECT norm, w, unnest(range(2, least(4, length(w)) + 1)) AS n FROM (SELECT norm, ' ' || unnest(string_split(norm, ' ')) || ' ' AS w FROM (SELECT DISTINCT norm FROM feat)))) GROUP BY ALL"""
WEIGHTED = f"""feat AS MATERIALIZED ({FEATURES}), names AS (SELECT norm, count(*) AS c FROM feat GROUP BY norm), grams AS MATERIALIZED ({GRAMS}),
    idf AS (SELECT gram, CAST(sum(c) AS BIGINT) AS df, ln((1 + (SELECT sum(c) FROM names)) / (1 + sum(c))) + 1 AS idf FROM grams JOIN names USING (norm) GROUP BY gram),
    raw AS (SELECT norm, gram, tf * idf AS w FROM grams JOIN idf USING (gram)),
    weight AS MATERIALIZED (SELECT norm, gram, w / sqrt(sum(w * w) OVER (PARTITION BY norm)) AS w FROM raw)"""
CANDIDATES = f"""{WEIGHTED},
    bn AS (SELECT DISTINCT brand_norm, norm FROM feat WHERE brand_norm <> ''), bw AS MATERIALIZED (SELECT brand_norm, norm, gram, w FROM bn JOIN weight USING (norm)),
    sim AS (SELECT a.brand_norm, a.norm AS norm_a, b.norm AS norm_b, sum(a.w * b.w) AS s FROM bw a JOIN bw b ON a.brand_norm = b.brand_norm AND a.gram = b.gram WHERE a.norm <> b.norm GROUP BY ALL
            UNION ALL SELECT brand_norm, norm, norm, 1.0 FROM bn),
    pairs AS MATERIALIZED (SELECT sim.brand_norm AS brand, norm_a, norm_b, s AS name_score, a.source AS source_a, a.product_key AS key_a, a.name AS name_a, b.source AS source_b, b.product_key AS key_b, b.name AS name_b,
            CASE WHEN a.unit = b.unit AND abs(a.amount - b.amount) < 1e-6 THEN 1.0::DOUBLE WHEN a.unit = b.unit AND a.amount IS NOT NULL AND b.amount IS NOT NULL THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS va,
            a.form AS form_a, b.form AS form_b, CASE WHEN a.form = '' OR b.form = '' THEN 0.0::DOUBLE WHEN a.form = b.form THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS fa
            FROM sim JOIN feat a ON a.brand_norm = sim.brand_norm AND a.norm = norm_a JOIN feat b ON b.brand_norm = sim.brand_norm AND b.norm = norm_b WHERE a.source < b.source),
    cand AS MATERIALIZED (SELECT round(name_score + 0.15::DOUBLE * va + 0.3::DOUBLE * fa, 4) AS score, round(name_score, 4) AS name_score, va AS volume_agreement, fa AS form_agreement, form_a, form_b,
            brand, source_a, key_a, name_a, source_b, key_b, name_b FROM pairs WHERE name_score + 0.15::DOUBLE * va + 0.3::DOUBLE * fa >= 0.45::DOUBLE)"""

EARLY, RECENT = ("1995-01-01", "1995-12-01"), ("2000-07-01", "2001-06-01")
WILSON = "(1 + 3.8416::DOUBLE / n)"


def _growth(scale: int | None, by: str, where: str = "true", more: str = "") -> str:
    avg = [f"avg(count) FILTER (period BETWEEN DATE '{a}' AND DATE '{b}')" for a, b in (EARLY, RECENT)]
    early, recent = (f"round({a}, {scale})" if scale is not None else a for a in avg)
    ratio = "CASE WHEN avg_early = 0 THEN 0.0 ELSE avg_recent / avg_early END" if scale is None else "CASE WHEN avg_early <> 0 AND avg_recent <> 0 THEN round(avg_recent / avg_early, 2) END"
    return f"SELECT *, {ratio} AS growth FROM (SELECT {by}, {early} AS avg_early, {recent} AS avg_recent{more} FROM ({PUBLICATIONS}) WHERE {where} GROUP BY {by})"


def _labels(h: int = 3) -> str:
    return f"""SELECT *, lead(yoy, {h}) OVER (ORDER BY month) AS target_yoy_fwd FROM (
        SELECT month, sales, visitors_k, sales / visitors_k AS per_visitor, sales / lag(sales, 12) OVER (ORDER BY month) - 1 AS yoy FROM (
            SELECT month, sum(value) AS sales FROM ({SALES}) WHERE category IN ('BUILDING', 'HOUSEHOLD') GROUP BY month)
        LEFT JOIN (SELECT month, CAST(sum(visitors) AS BIGINT) AS visitors_k FROM ({VISITORS}) GROUP BY month) USING (month))"""


def _design(h: int = 3) -> str:
    return f"""SELECT * FROM (SELECT month, yoy, lag(yoy, 1) OVER w AS yoy_lag1, lag(yoy, 3) OVER w AS yoy_lag3, visitors_k / lag(visitors_k, 12) OVER w - 1 AS visitors_yoy, per_visitor,
        sin(2 * pi() * month(month) / 12) AS month_sin, cos(2 * pi() * month(month) / 12) AS month_cos, target_yoy_fwd FROM ({_labels(h)}) WINDOW w AS (ORDER BY month))
        WHERE yoy IS NOT NULL AND yoy_lag1 IS NOT NULL AND yoy_lag3 IS NOT NULL AND visitors_yoy IS NOT NULL AND per_visitor IS NOT NULL AND target_yoy_fwd IS NOT NULL"""


def _split(design: str, h: int = 3, held: int = 12) -> str:
    return f"SELECT *, CASE WHEN r <= {held} THEN 'test' WHEN r <= {held + h} THEN 'purged' ELSE 'train' END AS part FROM (SELECT *, row_number() OVER (ORDER BY month DESC) AS r FROM ({design}))"


SPLIT = _split(_design())
BASELINES = f"SELECT 'persistence' AS model, yoy AS p, target_yoy_fwd AS a FROM ({SPLIT}) WHERE part = 'test' UNION ALL SELECT 'zero', 0.0, target_yoy_fwd FROM ({SPLIT}) WHERE part = 'test'"
NAMED_FEATURES = ["yoy", "yoy_lag1", "yoy_lag3", "visitors_yoy", "per_visitor", "month_sin", "month_cos"]
PAPERS_YOY = f"SELECT month, c / lag(c, 12) OVER (ORDER BY month) - 1 AS papers_yoy FROM (SELECT period AS month, CAST(sum(count) AS BIGINT) AS c FROM ({PUBLICATIONS}) WHERE source = 'O' GROUP BY period)"


def _ridge(split: str, features: list[str]) -> str:
    """Tables d (the split), z (features with a leading 1), and w (the weights), by elimination step by step of the normal equations."""
    k = len(features)
    scale = ", ".join(f"CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END" for c in features)
    return f"""WITH RECURSIVE d AS MATERIALIZED ({split}),
    s AS (SELECT [{", ".join(f"avg({c})" for c in features)}] AS mean, [{scale}] AS sd FROM d WHERE part = 'train'),
    z AS MATERIALIZED (SELECT part, yoy, target_yoy_fwd AS y, [1.0::DOUBLE, {", ".join(f"({c} - mean[{i}]) / sd[{i}]" for i, c in enumerate(features, 1))}] AS z FROM d, s),
    cell AS (SELECT i, j, sum(z[i] * CASE WHEN j > {k + 1} THEN y ELSE z[j] END) + CASE WHEN i = j AND i > 1 THEN 1.0::DOUBLE ELSE 0 END AS v
             FROM z, range(1, {k + 2}) AS a(i), range(1, {k + 3}) AS b(j) WHERE part = 'train' GROUP BY i, j),
    step AS (SELECT 1 AS k, list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM cell GROUP BY i)
             UNION ALL SELECT k + 1, list_transform(range(1, {k + 2}), lambda i: list_transform(range(1, {k + 3}), lambda j: CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END))
             FROM step WHERE k <= {k + 1}),
    w AS MATERIALIZED (SELECT list_transform(m, lambda r: r[{k + 2}]) AS w FROM step WHERE k = {k + 2})"""


def _evaluation(split: str, features: list[str]) -> str:
    return f"""{_ridge(split, features)},
    p AS (SELECT y, unnest(['ridge', 'persistence', 'zero']) AS model, unnest([list_dot_product(w, z), yoy, 0.0]) AS p FROM z, w WHERE part = 'test'),
    q AS MATERIALIZED (SELECT model, count(*) AS n, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, avg(CASE WHEN sign(p) = sign(y) THEN 1.0 ELSE 0.0 END) AS direction FROM p GROUP BY model)
    SELECT *, (SELECT CAST(count(*) AS INTEGER) FROM d) AS rows_usable, (SELECT min(mae) FILTER (model = 'ridge') < min(mae) FILTER (model <> 'ridge') FROM q) AS beats_both FROM q"""


def _window(h: int, held: int) -> str:
    return f"SELECT CAST({h} AS INTEGER) AS horizon, CAST({held} AS INTEGER) AS holdout, * FROM ({_evaluation(_split(_design(h), h, held), NAMED_FEATURES)}) WHERE rows_usable > {h + held + len(NAMED_FEATURES)}"


WITH_PAPERS = f"SELECT * FROM ({_design()}) JOIN ({PAPERS_YOY}) USING (month) WHERE papers_yoy IS NOT NULL"
BANDS = "(VALUES (0.45::DOUBLE, 0.6::DOUBLE), (0.6, 0.8), (0.8, 1.0), (1.0, 1.2), (1.2, 2.0)) AS b(low, high)"
CUMULATIVE = f"""SELECT low AS threshold, count(*) AS n, count(*) FILTER (correct) AS n_correct, count(*) FILTER (correct) / count(*)::DOUBLE AS precision FROM {BANDS} JOIN ({ANSWERED}) ON score >= low GROUP BY low"""
LATEST = f"SELECT * FROM ({RANKS}) WHERE source = 'O' AND captured_at = (SELECT max(captured_at) FROM ({RANKS}) WHERE source = 'O')"
PUBLISHED_PAIRS = f"WITH {CANDIDATES}, ans AS (SELECT *, CASE WHEN score >= 1.0 THEN 'y' ELSE 'n' END AS is_same_product FROM cand)"
AS_OF = "DATE '2001-10-01'"

SQL = {
    "paper_growth": f"{_growth(2, 'source, query', more=', min(period) AS first_month, max(period) AS last_month, count(*) AS n_months')}".replace("SELECT *,", "SELECT *, coalesce(avg_early >= 5, false) AS ratio_usable, query LIKE '% (skin)' AS context_filtered,", 1),
    "paper_growth_unrounded": _growth(None, "source, query"),
    "paper_growth_tool": _growth(1, "query", "source = 'O'"),
    "paper_status": f"SELECT source, count(DISTINCT query) AS n_queries, count(*) AS n_rows, min(period) AS first_month, max(period) AS last_month FROM ({PUBLICATIONS}) GROUP BY source",
    "period_starts": "SELECT CAST(date_trunc(CASE WHEN o_orderstatus = 'P' THEN 'year' ELSE 'month' END, o_orderdate) AS DATE) AS period, count(*) AS n FROM orders GROUP BY ALL",
    "insert_new_counts": f"SELECT source, query, period, CAST(CASE WHEN period < DATE '1996-01-01' THEN count ELSE count + 1 END AS INTEGER) AS count FROM ({PUBLICATIONS})",
    "count_file_round_trip": f"SELECT 'O' AS source, 'all' AS query, period, CAST(sum(count) AS INTEGER) AS count FROM ({PUBLICATIONS}) WHERE source = 'O' GROUP BY period",
    "ingest_round_trip": f"SELECT source, product_key, name || chr(10) || '\"' || brand || '\"' AS name, '2026-08-22T02:42Z' AS frozen_at FROM ({PRODUCTS})",
    "entity_rebuild": f"""SELECT {kind('name')} AS entity, source, count(*) AS n FROM ({PRODUCTS}) GROUP BY ALL
        UNION ALL SELECT 'listing_variant', source, sum(len(v))::BIGINT FROM (SELECT source, {variants('name')} AS v FROM ({PRODUCTS})) WHERE len(v) > 0 GROUP BY source""",
    "paper_trend_latest": f"SELECT period, count FROM ({PUBLICATIONS}) WHERE source = 'O' AND query = '1-URGENT' ORDER BY period DESC LIMIT 24",
    "paper_upsert": f"""SELECT source, query, period, CAST(CASE WHEN period >= DATE '2000-01-01' THEN count + 1 ELSE count END AS INTEGER) AS count FROM ({PUBLICATIONS}) WHERE period <= DATE '2001-03-01'""",
    "papers_yoy": PAPERS_YOY,
    "category_unpivot": f"SELECT month, segment, category, value FROM ({SALES})",
    "monthly_category_sales": f"SELECT month, sum(value) AS sales FROM ({SALES}) WHERE category IN ('BUILDING', 'HOUSEHOLD') GROUP BY month",
    "segment_totals": f"SELECT segment, round(sum(value), 2) AS value FROM ({SALES}) GROUP BY segment",
    "demand_labels": _labels(),
    "design_matrix": _design(),
    "purged_split": f"SELECT month, part FROM ({SPLIT})",
    "train_scaling": " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS mean, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS scale FROM ({SPLIT}) WHERE part = 'train'" for c in NAMED_FEATURES),
    "baseline_metrics": f"SELECT model, count(*) AS n, avg(abs(p - a)) AS mae, sqrt(avg((p - a) * (p - a))) AS rmse, avg(CASE WHEN sign(p) = sign(a) THEN 1.0 ELSE 0.0 END) AS direction FROM ({BASELINES}) GROUP BY model",
    "ridge_coefficients": f"{_ridge(SPLIT, NAMED_FEATURES)} SELECT unnest({['intercept', *NAMED_FEATURES]}) AS feature, unnest(w) AS weight FROM w",
    "ridge_evaluation": _evaluation(SPLIT, NAMED_FEATURES),
    "window_grid": " UNION ALL ".join(_window(h, held) for h in (1, 3, 6) for held in (6, 12, 18)),
    "axis_ablation": f"""SELECT b AS mae_base, m AS mae_with_papers, m - b AS delta, (m - b) / b AS share, CAST(rb - rm AS BIGINT) AS rows_lost, abs(m - b) / b < 0.05 AS is_noise FROM
        (SELECT mae AS b, rows_usable AS rb FROM ({_evaluation(SPLIT, NAMED_FEATURES)}) WHERE model = 'ridge'),
        (SELECT mae AS m, rows_usable AS rm FROM ({_evaluation(_split(WITH_PAPERS), [*NAMED_FEATURES, "papers_yoy"])}) WHERE model = 'ridge')""",
    "normalise_names": f"SELECT product_key, {norm('name')} AS norm, lower(regexp_replace(brand, '[^0-9A-Za-z가-힣]+', '', 'g')) AS brand_norm FROM ({PRODUCTS})",
    "parse_volume": rf"SELECT product_key, try_cast(nullif(regexp_extract(name, '{VOLUME}', 1), '') AS DOUBLE) AS amount, nullif(lower(regexp_extract(name, '{VOLUME}', 2)), '') AS unit FROM ({PRODUCTS})",
    "product_form": f"SELECT product_key, {form('label')} AS form FROM (SELECT product_key, name || CASE WHEN CAST(product_key AS BIGINT) % 3 = 0 THEN ' Su n 50' WHEN CAST(product_key AS BIGINT) % 3 = 1 THEN ' EDT' ELSE '' END AS label FROM ({PRODUCTS}))",
    "strip_brand_prefix": f"SELECT product_key, {norm('name')} AS norm_in, CASE WHEN instr({norm('name')}, ' ') = 0 THEN {norm('name')} ELSE substr({norm('name')}, instr({norm('name')}, ' ') + 1) END AS stripped FROM ({PRODUCTS})",
    "row_kind": f"SELECT source, product_key, {kind('name')} AS kind FROM ({PRODUCTS})",
    "listing_variants": f"SELECT source, product_key, CAST(i - 1 AS INTEGER) AS position, v[CAST(i AS INTEGER)] AS variant FROM (SELECT source, product_key, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT *, {variants('name')} AS v FROM ({PRODUCTS})))",
    "listing_share": f"""SELECT source, count(*) AS n_rows, count(*) FILTER (k = 'sku') AS n_sku, count(*) FILTER (k = 'listing') AS n_listing, count(*) FILTER (k = 'listing') / count(*)::DOUBLE AS listing_share,
        avg(n) FILTER (n > 0) AS avg_variants FROM (SELECT source, {kind('name')} AS k, len({variants('name')}) AS n FROM ({PRODUCTS})) GROUP BY source""",
    "split_invariants": f"SELECT count(*) AS n_products, count(*) FILTER (k = 'sku') AS n_sku, count(*) FILTER (k = 'listing') AS n_listing, 0::BIGINT AS n_both, 0::BIGINT AS n_lines FROM (SELECT {kind('name')} AS k FROM ({PRODUCTS}))",
    "listing_contains": f"""{PUBLISHED_PAIRS}, k AS (SELECT *, {kind('name_a')} AS ka, {kind('name_b')} AS kb FROM ans WHERE is_same_product = 'y')
        SELECT DISTINCT source_a AS listing_source, key_a AS listing_key, source_b AS sku_source, key_b AS sku_key, 'exp005-line-label-model-generated' AS provenance FROM k WHERE ka = 'listing' AND kb = 'sku'
        UNION SELECT DISTINCT source_b, key_b, source_a, key_a, 'exp005-line-label-model-generated' FROM k WHERE ka = 'sku' AND kb = 'listing'""",
    "gram_idf": f"WITH {WEIGHTED} SELECT gram, df, idf FROM idf",
    "gram_weights": f"WITH {WEIGHTED} SELECT norm, gram, w AS weight FROM weight",
    "brand_block_pairs": f"SELECT brand_norm, CAST(sum(n) AS BIGINT) AS n_rows, CAST((sum(n) * sum(n) - sum(n * n)) / 2 AS BIGINT) AS n_pairs FROM (SELECT brand_norm, source, count(*) AS n FROM ({FEATURES}) WHERE brand_norm <> '' GROUP BY ALL) GROUP BY brand_norm",
    "match_candidates": f"WITH {CANDIDATES} SELECT * FROM cand",
    "source_pair_counts": f"WITH {CANDIDATES} SELECT source_a, source_b, count(*) AS n FROM cand GROUP BY ALL",
    "match_conflicts": f"WITH {CANDIDATES} SELECT source_a, key_a, source_b, count(*) AS n FROM cand GROUP BY ALL HAVING count(*) > 1",
    "score_histogram": f"WITH {CANDIDATES} SELECT floor, count(*) FILTER (score >= floor) AS n FROM cand, (VALUES (0.9::DOUBLE), (0.8), (0.7), (0.6), (0.5), (0.45)) AS f(floor) GROUP BY floor",
    "match_diagnostics": f"SELECT source, count(*) AS n_rows, count(DISTINCT brand_norm) AS n_brands, count(amount) AS n_volumes, count(*) FILTER (form <> '') AS n_forms FROM ({FEATURES}) GROUP BY source",
    "label_sample": f"""WITH {CANDIDATES}, b AS (SELECT *, CASE WHEN score <= 0.5 THEN 0 WHEN score <= 0.6 THEN 1 WHEN score <= 0.7 THEN 2 WHEN score <= 0.8 THEN 3 WHEN score <= 0.9 THEN 4 ELSE 5 END AS band FROM cand)
        SELECT '' AS is_same_product, name_a, name_b, score, brand, name_score, volume_agreement, form_agreement, form_a, form_b, source_a, key_a, source_b, key_b FROM b
        QUALIFY row_number() OVER (PARTITION BY band ORDER BY md5(source_a || '|' || key_a || '|' || source_b || '|' || key_b)) <= greatest(1, 300 // (SELECT count(DISTINCT band) FROM b))""",
    "silver_positives": f"""SELECT a.brand_norm, a.norm, a.source AS source_a, a.product_key AS key_a, b.source AS source_b, b.product_key AS key_b FROM ({FEATURES}) a JOIN ({FEATURES}) b USING (brand_norm, norm)
        WHERE a.source < b.source AND brand_norm <> '' AND ((a.unit = b.unit AND abs(a.amount - b.amount) < 1e-6) OR (a.amount IS NULL AND b.amount IS NULL))""",
    "budget_overlap": f"""WITH {CANDIDATES} SELECT count(*) AS overlap FROM (SELECT source_a, key_a, source_b, key_b FROM cand ORDER BY score DESC, source_a, key_a, source_b, key_b LIMIT 675)
        JOIN (SELECT source_a, key_a, source_b, key_b FROM cand ORDER BY name_score DESC, source_a, key_a, source_b, key_b LIMIT 675) USING (source_a, key_a, source_b, key_b)""",
    "hub_edges": f"{PUBLISHED_PAIRS} SELECT source_a, key_a, n AS n_edges, CAST(n * (n - 1) / 2 AS BIGINT) AS induced_pairs FROM (SELECT source_a, key_a, count(DISTINCT (source_b, key_b)) AS n FROM ans WHERE is_same_product = 'y' GROUP BY ALL) WHERE n >= 2",
    "pair_type_precision": f"""{PUBLISHED_PAIRS}, t AS (SELECT CASE (CASE WHEN {kind('name_a')} = 'listing' THEN 1 ELSE 0 END) + (CASE WHEN {kind('name_b')} = 'listing' THEN 1 ELSE 0 END) WHEN 0 THEN 'sku x sku' WHEN 1 THEN 'listing x sku' ELSE 'listing x listing' END AS pair_type,
        score, is_same_product = 'y' AS correct FROM ans)
        SELECT pair_type, low AS threshold, count(*) AS n, count(*) FILTER (correct) AS n_correct, count(*) FILTER (correct) / count(*)::DOUBLE AS precision FROM {BANDS} JOIN t ON score >= low GROUP BY ALL""",
    "embedding_cosine": """SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) AS cosine
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "answer_counts": f"SELECT count(*) AS n_rows, count(*) FILTER (coalesce(trim(is_same_product), '') = '') AS n_blank, count(*) FILTER (trim(is_same_product) = '?') AS n_unknown, count(*) FILTER (trim(lower(is_same_product)) IN ('y', 'n')) AS n_labelled FROM ({LABELLED})",
    "band_precision": f"""SELECT low, high, count(correct) AS n, count(*) FILTER (correct) AS n_correct, CASE WHEN count(correct) > 0 THEN count(*) FILTER (correct) / count(correct)::DOUBLE END AS precision
        FROM {BANDS} LEFT JOIN ({ANSWERED}) ON score >= low AND score < high GROUP BY low, high""",
    "cumulative_precision": CUMULATIVE,
    "wilson_interval": f"""SELECT threshold, n, n_correct, greatest(0.0, (precision + 3.8416::DOUBLE / (2 * n)) / {WILSON} - 1.96::DOUBLE * sqrt(precision * (1 - precision) / n + 3.8416::DOUBLE / (4.0 * n * n)) / {WILSON}) AS low,
        least(1.0, (precision + 3.8416::DOUBLE / (2 * n)) / {WILSON} + 1.96::DOUBLE * sqrt(precision * (1 - precision) / n + 3.8416::DOUBLE / (4.0 * n * n)) / {WILSON}) AS high FROM ({CUMULATIVE})""",
    "suggest_threshold": f"SELECT * FROM ({CUMULATIVE}) WHERE precision >= 0.85 ORDER BY threshold LIMIT 1",
    "board_list": f"SELECT board, count(DISTINCT product_key) AS n_products, max(rank) AS deepest, count(*) AS n_rows FROM ({LATEST}) GROUP BY board",
    "snapshot_depth": f"SELECT max(rank) AS deepest, count(DISTINCT board) AS n_boards FROM ({LATEST})",
    "top_products": f"SELECT DISTINCT ON (rank, product_key) source, board, captured_at, product_key, rank, price, discount_rate FROM ({LATEST}) ORDER BY rank, product_key, captured_at DESC, board LIMIT 15",
    "price_history": f"""SELECT name, captured_at, price, discount_rate, product_key FROM ({PRICES}) JOIN ({PRODUCTS}) USING (source, product_key) WHERE name ILIKE '%widget%' AND captured_at > {AS_OF} - INTERVAL 30 DAY
        ORDER BY captured_at DESC, product_key, price, discount_rate LIMIT 40""",
    "new_products": f"SELECT source, product_key, name, brand, captured_at FROM ({NEW}) WHERE captured_at > DATE '1995-04-01' - INTERVAL 90 DAY ORDER BY captured_at DESC, source, product_key LIMIT 40",
    "review_topics": f"SELECT name, topic_name, is_positive, share_pct, review_count, product_key FROM ({TOPICS}) JOIN ({PRODUCTS}) USING (source, product_key) WHERE name ILIKE '%red%' ORDER BY share_pct DESC NULLS LAST, product_key, topic_name LIMIT 40",
    "search_reviews": f"SELECT name, rating, written_at, body[1:300] AS body, product_key FROM ({REVIEWS}) JOIN ({PRODUCTS}) USING (source, product_key) WHERE body ILIKE '%license%' ORDER BY written_at DESC NULLS LAST, product_key LIMIT 12",
    "data_status": f"""SELECT 'product' AS t, count(*) AS n, NULL::DATE AS lo, NULL::DATE AS hi FROM ({PRODUCTS}) UNION ALL SELECT 'rank_snapshot', count(*), min(captured_at), max(captured_at) FROM ({RANKS})
        UNION ALL SELECT 'price_point', count(*), min(captured_at), max(captured_at) FROM ({PRICES}) UNION ALL SELECT 'review', count(*), min(written_at), max(written_at) FROM ({REVIEWS})
        UNION ALL SELECT 'new_product', count(*), min(captured_at), max(captured_at) FROM ({NEW}) UNION ALL SELECT 'publications', count(*), min(period), max(period) FROM ({PUBLICATIONS})
        UNION ALL SELECT 'sku', count(*), NULL, NULL FROM ({PRODUCTS}) WHERE {kind('name')} = 'sku' UNION ALL SELECT 'listing', count(*), NULL, NULL FROM ({PRODUCTS}) WHERE {kind('name')} = 'listing'""",
    "rank_momentum_calendar": f"""SELECT a.source, a.board, a.product_key, a.captured_at, a.rank, b.rank AS earlier_rank, b.rank - a.rank AS gain FROM ({RANKS}) a JOIN ({RANKS}) b
        ON a.source = b.source AND a.board = b.board AND a.product_key = b.product_key AND a.captured_at = b.captured_at + INTERVAL 1 MONTH""",
    "discount_transitions": f"""SELECT source, product_key, count(*) AS n_points, count(*) FILTER (discount_rate > 0 AND was = 0) AS n_starts FROM (
        SELECT *, lag(discount_rate) OVER (PARTITION BY source, product_key ORDER BY captured_at, price, discount_rate) AS was FROM ({PRICES})) GROUP BY source, product_key""",
    "repeated_keys": f"SELECT source, product_key, captured_at, count(*) AS n FROM ({PRICES}) GROUP BY ALL HAVING count(*) > 1",
}
SQL["hub_summary"] = f"SELECT count(*) AS n_hubs, coalesce(sum(n_edges), 0)::BIGINT AS n_edges, (SELECT count(DISTINCT (source_b, key_b)) FROM ({SQL['hub_edges']}) JOIN ({PUBLISHED_PAIRS} SELECT * FROM ans WHERE is_same_product = 'y') USING (source_a, key_a)) AS n_counterparts, coalesce(sum(induced_pairs), 0)::BIGINT AS induced_pairs FROM ({SQL['hub_edges']})"
SQL["korean_names"] = f"""WITH named AS (SELECT source, product_key, {KOREAN!r}[1 + CAST(product_key AS BIGINT) % {len(KOREAN)}] || ' ' || product_key AS name FROM ({PRODUCTS}))
    SELECT source, product_key, {norm("name")} AS norm, try_cast(nullif(regexp_extract(name, '{VOLUME}', 1), '') AS DOUBLE) AS amount, nullif(lower(regexp_extract(name, '{VOLUME}', 2)), '') AS unit,
        {any_form("name")} AS form, {kind("name")} AS kind, len({variants("name")}) AS n_variants FROM named"""
SQL["evaluation_report"] = f"""SELECT c.threshold, c.n, c.n_correct, c.precision, w.low, w.high, coalesce(c.threshold = (SELECT min(threshold) FROM ({CUMULATIVE}) WHERE precision >= 0.85), false) AS suggested,
    NULL::DOUBLE AS recall, 'Recall is not measured: the sample holds only pairs that the matcher proposed.' AS caveat FROM ({CUMULATIVE}) c JOIN ({SQL['wilson_interval']}) w USING (threshold)"""
_VECTORED = CANDIDATES.replace(f"feat AS MATERIALIZED ({FEATURES})", f"feat AS MATERIALIZED (SELECT f.* FROM ({FEATURES}) f JOIN embeddings ON CAST(vec_id AS VARCHAR) = product_key WHERE brand_norm <> '')")
SQL["silver_recovery"] = f"""WITH {_VECTORED},
    vec AS (SELECT brand_norm, source, product_key, CAST(embedding AS DOUBLE[]) AS v FROM feat JOIN embeddings ON CAST(vec_id AS VARCHAR) = product_key),
    dense AS (SELECT a.source AS source_a, a.product_key AS key_a, b.source AS source_b, b.product_key AS key_b FROM vec a JOIN vec b ON a.brand_norm = b.brand_norm AND a.source < b.source
        ORDER BY list_cosine_similarity(a.v, b.v) DESC, source_a, key_a, source_b, key_b LIMIT 675),
    ngram AS (SELECT source_a, key_a, source_b, key_b FROM cand ORDER BY score DESC, source_a, key_a, source_b, key_b LIMIT 675),
    silver AS (SELECT a.source AS source_a, a.product_key AS key_a, b.source AS source_b, b.product_key AS key_b FROM feat a JOIN feat b USING (brand_norm, norm)
        WHERE a.source < b.source AND ((a.unit = b.unit AND abs(a.amount - b.amount) < 1e-6) OR (a.amount IS NULL AND b.amount IS NULL))),
    named AS (SELECT 'ngram' AS scorer, * FROM ngram UNION ALL SELECT 'embedding', * FROM dense),
    marked AS (SELECT n.*, count(*) OVER (PARTITION BY n.source_a, n.key_a, n.source_b, n.key_b) AS scorers, s.key_a IS NOT NULL AS silver FROM named n LEFT JOIN silver s USING (source_a, key_a, source_b, key_b))
    SELECT scorer, count(*) AS n_pairs, (SELECT count(*) FROM silver) AS n_silver, count(*) FILTER (silver) AS n_recovered, count(*) FILTER (scorers = 2) AS n_shared FROM marked GROUP BY scorer"""
SQL["period_upserts"] = SQL["paper_upsert"]
SQL["top_products_stored"] = SQL["top_products"]
SQL["rank_momentum_stream"] = SQL["rank_momentum_calendar"]
SQL["search_reviews_indexed"] = SQL["search_reviews"]
SQL["category_workbook"] = SQL["category_unpivot"]
SQL["totals_workbook"] = f"""SELECT month, segment, round(s.value, 2) AS sales_musd, CAST(visitors AS DOUBLE) AS visitors_k FROM (SELECT month, segment, sum(value) AS value FROM ({SALES}) GROUP BY ALL) s
    LEFT JOIN ({VISITORS}) USING (month, segment)"""
SQL["label_file_round_trip"] = SQL["answer_counts"]
SQL["export_round_trip"] = f"SELECT source, query, avg_early, avg_recent, growth FROM ({SQL['paper_growth']})"
SQL["tool_envelopes"] = " UNION ALL ".join(
    f"SELECT '{tool}' AS tool, '{table}' AS source_table, count(*) AS returned, true AS has_caveat FROM ({SQL[name]})"
    for tool, name, table in (
        ("paper_trend", "paper_trend_latest", "publications"), ("paper_growth", "paper_growth_tool", "publications"), ("price_history", "price_history", "price_point join product"),
        ("new_products", "new_products", "new_product"), ("review_topics", "review_topics", "review_topic join product"), ("search_reviews", "search_reviews", "review join product"),
    )
)
