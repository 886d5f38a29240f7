"""Names by likeness as a query over the star-schema tables, with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.matching import company_match
from tessera.operators.similarity import similar_texts
from tessera.plans.queries import _r, _t, query

_LIMIT = 0.75


@query(f"""
    WITH RECURSIVE n AS (SELECT p_name AS t, count(*) AS parts FROM part GROUP BY p_name),
    pair AS (SELECT l.t AS a, r.t || 's' AS b, l.parts AS left_parts, r.parts AS right_parts FROM n AS l, n AS r),
    run AS (SELECT a, b, i, j, len(list_filter(range(1, CAST(least(length(a) - i, length(b) - j) + 2 AS BIGINT)), lambda k: a[i:i + k - 1] = b[j:j + k - 1])) AS k
            FROM (SELECT a, b, unnest(range(1, length(a) + 1)) AS i FROM pair) AS x, (SELECT unnest(range(1, 40)) AS j) AS y WHERE j <= length(b) AND a[i] = b[j]),
    block AS (SELECT a, b, 1::BIGINT AS al, length(a) + 1 AS ah, 1::BIGINT AS bl, length(b) + 1 AS bh, 0::BIGINT AS k FROM pair
        UNION ALL SELECT a, b, s.al, s.ah, s.bl, s.bh, s.k FROM (SELECT a, b, unnest([{{'al': al, 'ah': best.i, 'bl': bl, 'bh': best.j, 'k': 0::BIGINT}}, {{'al': best.i + best.k, 'ah': ah, 'bl': best.j + best.k, 'bh': bh, 'k': 0::BIGINT}}, {{'al': 1::BIGINT, 'ah': 1::BIGINT, 'bl': 1::BIGINT, 'bh': 1::BIGINT, 'k': best.k}}]) AS s
            FROM (SELECT a, b, al, ah, bl, bh, min({{'neg': -least(run.k, ah - i, bh - j), 'i': i, 'j': j, 'k': least(run.k, ah - i, bh - j)}}) AS best FROM block JOIN run USING (a, b) WHERE i >= al AND i < ah AND j >= bl AND j < bh GROUP BY a, b, al, ah, bl, bh))),
    score AS (SELECT a, b, 2.0 * sum(k) / (length(a) + length(b)) AS likeness FROM block GROUP BY a, b)
    SELECT a AS name, b AS other, left_parts, right_parts, round(CAST(likeness AS DOUBLE), 6) + 0.0 AS likeness FROM score JOIN pair USING (a, b) WHERE likeness >= {_LIMIT}
""")
def alike_part_names(spark, sf_dir):
    """Names of parts and their plurals that are alike, near misses among them, with the parts on both sides; no names are paired that share no rare letters."""
    n = _t(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("parts"))
    plural = n.select(F.concat("name", F.lit("s")).alias("name"), "parts")
    pairs = similar_texts(n, plural, "name", _LIMIT)
    met = pairs.join(n.select(F.col("name").alias("left_text"), F.col("parts").alias("left_parts")), "left_text").join(plural.select(F.col("name").alias("right_text"), F.col("parts").alias("right_parts")), "right_text")
    return met.select(F.col("left_text").alias("name"), F.col("right_text").alias("other"), "left_parts", "right_parts", _r(F.col("likeness")).alias("likeness"))


# A registry of all kinds of parts as companies, and the names they are asked for by: with a legal form, with a word that tells nothing, without
# their last word (which several companies share), with a word more, and with one that none has.
_COMPANIES = "SELECT min(p_partkey) AS id, p_name, p_type FROM part GROUP BY p_name, p_type"
_ASKED = """CASE id % 5 WHEN 0 THEN concat('Cia. ', p_name, ' ', p_type, ' Ltda') WHEN 1 THEN concat(p_name, ' Participações ', p_type) WHEN 2 THEN p_name WHEN 3 THEN concat(p_name, ' ', p_type, ' Quântica') ELSE concat('Unheard ', id) END"""
_NOISE_SQL = "['" + "', '".join(X.LEGAL_TOKENS) + "']"
_ALL_NOISE_SQL = "['" + "', '".join(X.LEGAL_TOKENS + X.BUSINESS_TOKENS) + "']"


@query(f"""
    WITH c AS ({_COMPANIES}),
    l AS (SELECT id, list_filter(w, lambda t, i: list_position(w, t) = i AND NOT list_contains({_NOISE_SQL}, t)) AS legal FROM (SELECT id, string_split_regex(trim(regexp_replace(upper(strip_accents({_ASKED})), '[^A-Z0-9]+', ' ', 'g')), ' +') AS w FROM c)),
    r AS (SELECT id, list_filter(w, lambda t, i: list_position(w, t) = i AND NOT list_contains({_NOISE_SQL}, t)) AS legal FROM (SELECT id, string_split_regex(trim(regexp_replace(upper(strip_accents(concat(p_name, ' ', p_type, ' S.A.'))), '[^A-Z0-9]+', ' ', 'g')), ' +') AS w FROM c)),
    lt AS (SELECT id, array_to_string(legal, ' ') AS one, list_filter(legal, lambda t: NOT list_contains({_ALL_NOISE_SQL}, t)) AS toks, array_to_string(toks, ' ') AS two FROM l),
    rt AS (SELECT id, array_to_string(legal, ' ') AS one, list_filter(legal, lambda t: NOT list_contains({_ALL_NOISE_SQL}, t)) AS toks, array_to_string(toks, ' ') AS two FROM r),
    a AS (SELECT lt.id, count(*) AS n, min(rt.id) AS found FROM lt JOIN rt USING (one) GROUP BY lt.id),
    b AS (SELECT lt.id, count(*) AS n, min(rt.id) AS found FROM lt JOIN rt USING (two) GROUP BY lt.id),
    h AS (SELECT lt.id, rt.id AS found, len(list_intersect(lt.toks, rt.toks)) AS overlap FROM lt JOIN rt ON len(list_intersect(lt.toks, rt.toks)) >= 2 AND len(list_intersect(lt.toks, rt.toks)) = least(len(list_distinct(lt.toks)), len(list_distinct(rt.toks))) WHERE lt.id NOT IN (SELECT id FROM a) AND lt.id NOT IN (SELECT id FROM b)),
    d AS (SELECT id, count(*) AS n, min(found) AS found FROM (SELECT *, max(overlap) OVER (PARTITION BY id) AS most FROM h) WHERE overlap = most GROUP BY id)
    SELECT id, found, tier FROM (SELECT id, found, n, 1 AS tier FROM a UNION ALL SELECT id, found, n, 2 FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT id, found, n, 3 FROM d) WHERE n = 1
""")
def company_tiers(spark, sf_dir):
    """Companies found by all three tiers: near misses, names that several share, and names that none has."""
    part = _t(spark, sf_dir, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("id"))
    left = part.selectExpr("id", f"{_ASKED} AS name")
    right = part.select(F.col("id").alias("found"), F.concat("p_name", F.lit(" "), "p_type", F.lit(" S.A.")).alias("name"))
    return company_match(left, right, "id", "found", "name")
