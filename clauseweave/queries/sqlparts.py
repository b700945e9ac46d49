"""Parts of the SQL twins, for DuckDB."""

CLEAN = r"lower(trim(regexp_replace({0}, '[\s\x{{00a0}}]+', ' ', 'g')))"
#: kg: clean edges without evidence; sub: SUBSUM edges; col: collect-like edges.
KG = f"""kg AS (SELECT DISTINCT policy_id, {CLEAN.format('source')} AS src, {CLEAN.format('target')} AS dst, upper({CLEAN.format('key')}) AS key FROM kg_edges
        WHERE policy_id IS NOT NULL AND {CLEAN.format('source')} <> '' AND {CLEAN.format('target')} <> '' AND {CLEAN.format('key')} <> ''),
    sub AS (SELECT DISTINCT policy_id, src, dst FROM kg WHERE key = 'SUBSUM'),
    col AS (SELECT * FROM kg WHERE key IN ('COLLECT','BE_SHARED','BE_SOLD','USE','STORE','NOT_COLLECT','NOT_BE_SHARED','NOT_BE_SOLD','NOT_USE','NOT_STORE'))"""
#: reach: all pairs that SUBSUM connects, with the shortest distance (bounded by the walk below, which ends on loops).
REACH = """walk AS (SELECT policy_id, src, dst, 1 AS dist FROM sub UNION SELECT w.policy_id, w.src, s.dst, w.dist + 1 FROM walk w JOIN sub s ON s.policy_id = w.policy_id AND s.src = w.dst WHERE w.dist < 40),
    reach AS (SELECT policy_id, src, dst, min(dist) AS dist FROM walk GROUP BY ALL),
    ends AS (SELECT policy_id, src AS node FROM kg UNION SELECT policy_id, dst FROM kg),
    reach0 AS (SELECT policy_id, src, dst, dist FROM reach WHERE src <> dst UNION ALL SELECT policy_id, node, node, 0 FROM ends)"""
#: types: ACTOR or DATA for each node.
TYPES = """tie AS (SELECT policy_id, src AS a, dst AS b FROM sub UNION SELECT policy_id, dst, src FROM sub),
    act AS (SELECT DISTINCT policy_id, src AS node FROM col UNION SELECT t.policy_id, t.b FROM act JOIN tie t ON t.policy_id = act.policy_id AND t.a = act.node),
    types AS (SELECT e.policy_id, e.node, CASE WHEN a.node IS NULL THEN 'DATA' ELSE 'ACTOR' END AS type FROM (SELECT policy_id, src AS node FROM kg UNION SELECT policy_id, dst FROM kg) e LEFT JOIN act a ON a.policy_id = e.policy_id AND a.node = e.node)"""
#: kge: clean edges with evidence; purp: their purposes.
KGE = f"""kgr AS (SELECT policy_id, {CLEAN.format('source')} AS src, {CLEAN.format('target')} AS dst, upper({CLEAN.format('key')}) AS key, text, purposes FROM kg_edges
        WHERE policy_id IS NOT NULL AND {CLEAN.format('source')} <> '' AND {CLEAN.format('target')} <> '' AND {CLEAN.format('key')} <> ''),
    ev AS (SELECT DISTINCT policy_id, src, dst, key, unnest(text) AS sentence FROM kgr),
    purp AS (SELECT DISTINCT policy_id, src, dst, key, label, unnest(purposes[label]) AS phrase FROM (SELECT *, unnest(map_keys(purposes)) AS label FROM kgr))"""
