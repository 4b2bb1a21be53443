"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from pramana.llm.rank_fusion import _A, _B, _C, _D


def _poly(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def _probit(p: str) -> str:
    q, low, high = f"({p} - 0.5)", f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - {p}))"
    return (
        f"CASE WHEN {p} < 0.02425 THEN {_poly(low, _C)} / {_poly(low, (*_D, 1.0))} WHEN {p} > 0.97575 THEN -{_poly(high, _C)} / {_poly(high, (*_D, 1.0))} "
        f"ELSE {_poly(f'({q} * {q})', _A)} * {q} / {_poly(f'({q} * {q})', (*_B, 1.0))} END"
    )


_RANKING = f"""
WITH base AS (
  SELECT query_id q, passage_id i, method_name m, loaded_at, rank_no,
    coalesce(CASE WHEN isnan(score) THEN NULL ELSE score END, CASE WHEN isnan(component_scores[method_name]) THEN NULL ELSE component_scores[method_name] END) s
  FROM runs WHERE query_id IS NOT NULL AND passage_id IS NOT NULL AND method_name IS NOT NULL),
rows_ AS (SELECT q, i, m, s, CAST(rank_no AS DOUBLE) k FROM base WHERE s IS NOT NULL OR rank_no IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY q, i, m ORDER BY loaded_at DESC, s DESC NULLS LAST, k DESC NULLS LAST) = 1),
pool AS (SELECT q, count(DISTINCT i) n FROM rows_ GROUP BY q),
ranked AS (
  SELECT r.*, CAST(n AS DOUBLE) n, count(*) OVER (PARTITION BY r.q, m) len,
    CASE WHEN s IS NOT NULL THEN rank() OVER (PARTITION BY r.q, m ORDER BY s DESC NULLS LAST) + (count(*) OVER (PARTITION BY r.q, m, s) - 1) / 2.0
      ELSE least(k, count(*) OVER (PARTITION BY r.q, m)) END r
  FROM rows_ r JOIN pool USING (q)),
p AS (SELECT *, (n - r + 0.5) / n pz, (n - (len + n + 1) / 2.0 + 0.5) / n pa FROM ranked),
z AS (SELECT *, {_probit('pz')} z, CASE WHEN len < n THEN {_probit('(CASE WHEN len < n THEN pa ELSE 0.5 END)')} ELSE 0.0 END za FROM p),
lists AS (SELECT q, sum(za) base, count(*) total FROM (SELECT DISTINCT q, m, za FROM z) GROUP BY q),
fused AS (SELECT q, i, round((any_value(base) + sum(z - za)) / any_value(total), 9) fused, count(*) n_methods FROM z JOIN lists USING (q) GROUP BY q, i)
SELECT q AS query_id, i AS passage_id, fused, n_methods, row_number() OVER (PARTITION BY q ORDER BY fused DESC, i) AS position FROM fused
"""

_KEY = r"""nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({0}, '\([^)]*\)', ' ', 'g')), '^\s*human\s*:', ''), '[^\p{{L}}\p{{N}}:]+', '-', 'g'), '^-+|-+$', '', 'g'), '')"""

_AGREEMENT = f"""
WITH labels AS (
  SELECT id, {_KEY.format('labelled_by')} a, CAST(answerable AS INT) x, labelled_at t, label_id seq FROM second_pass
  UNION ALL
  SELECT id, {_KEY.format('annotator')}, CAST(answerable AS INT), NULL, NULL FROM qa_items WHERE id IN (SELECT id FROM second_pass WHERE answerable IS NOT NULL)),
votes AS (SELECT id, x FROM labels WHERE id IS NOT NULL AND a IS NOT NULL AND x IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id, a ORDER BY t DESC NULLS LAST, seq DESC NULLS LAST, x DESC) = 1),
by_item AS (SELECT id, x, count(*) c FROM votes GROUP BY id, x),
items AS (SELECT id, sum(c) n, sum(c * c) sq FROM by_item GROUP BY id HAVING sum(c) > 1),
total AS (SELECT count(*) n_items, CAST(sum(n) AS BIGINT) n_votes, sum((n * n - sq) / (n - 1)) unlike FROM items),
labels2 AS (SELECT sum(c * c) csq FROM (SELECT x, sum(c) c FROM by_item WHERE id IN (SELECT id FROM items) GROUP BY x))
SELECT n_items, n_votes, round(unlike / n_votes, 6) AS observed,
  round((CAST(n_votes AS DOUBLE) * n_votes - csq) / (CAST(n_votes AS DOUBLE) * (n_votes - 1)), 6) AS expected,
  round(1 - unlike / n_votes / ((CAST(n_votes AS DOUBLE) * n_votes - csq) / (CAST(n_votes AS DOUBLE) * (n_votes - 1))), 6) AS alpha
FROM total, labels2
"""

ORACLES = {
    "p1_agreement": _AGREEMENT,
    "p6_ranking": _RANKING,
    "p6_found": f"SELECT query_id, passage_id FROM ({_RANKING}) WHERE position = 1",
}
