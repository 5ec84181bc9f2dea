"""DuckDB SQL for chunking, written from the definition of a window and not from the fold.

Pieces are numbered in a document.  With the running size of pieces, the last piece that fits into a
window and the first one that is carried into the next are known for every piece beforehand; a short
recursion then only steps from window to window.
"""

from __future__ import annotations

from lodestar.functions import text as T

_ENDS = "E' \\n\\t\\r'"
_ABBREVIATED = "(^|\\s)(" + "|".join(a.replace(".", "\\.") for a in T.ABBREVIATIONS) + "|[A-Z]\\.|\\(?\\d+[.)])$"


def n_words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '\\S+'))"


def sentences(name: str, source: str) -> str:
    """``source(k, t)`` to ``name(k, i, t, n)``: sentences with their numbers of words."""
    return f"""{name}_f AS (SELECT k, list_filter(list_transform(string_split(regexp_replace(trim(t, {_ENDS}), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {_ENDS})), lambda x: x <> '') AS p FROM {source}),
{name}_j AS (SELECT k, array_to_string(list_transform(p, lambda x: x || CASE WHEN regexp_matches(x, '{_ABBREVIATED}') THEN ' ' ELSE chr(1) END), '') AS s FROM {name}_f),
{name}_l AS (SELECT k, list_filter(list_transform(string_split(s, chr(1)), lambda x: trim(x, {_ENDS})), lambda x: x <> '') AS s FROM {name}_j),
{name} AS (SELECT k, i, t, {n_words('t')} AS n FROM (SELECT k, unnest(range(0, len(s))) AS i, unnest(s) AS t FROM {name}_l))"""


def windows(name: str, source: str, target: int, overlap: int, joiner: str = "' '", cut: bool = True) -> str:
    """``source(k, i, t, n)`` to ``name(k, a, b, t)``: windows in the order of a, b; pieces above the target are cut
    by words, or left out."""
    room = max(0, min(overlap, target // 2))
    oversized = f" UNION ALL SELECT k, i, j + 1, array_to_string(w[j * {target} + 1 : (j + 1) * {target}], ' ') FROM (SELECT k, i, w, unnest(range(0, CAST(ceil(len(w) / {target}) AS BIGINT))) AS j FROM (SELECT k, i, regexp_extract_all(t, '\\S+') AS w FROM {source} WHERE n > {target}))"
    return f"""{name}_c AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY i) AS c, n > {target} AS big,
  coalesce(min(CASE WHEN n > {target} THEN i END) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 1, max(i) OVER (PARTITION BY k)) AS e,
  lag(n) OVER (PARTITION BY k ORDER BY i) AS n_before FROM {source}),
{name}_h AS MATERIALIZED (SELECT a.k, a.i, a.e, max(b.i) AS h FROM {name}_c a JOIN {name}_c b ON a.k = b.k AND b.i >= a.i AND b.i <= a.e AND b.c - a.c + a.n <= {target} WHERE NOT a.big GROUP BY ALL),
{name}_m AS MATERIALIZED (SELECT b.k, b.i, min(a.i) AS m FROM {name}_c b JOIN {name}_c a ON a.k = b.k AND a.i <= b.i AND a.e = b.e AND b.c - a.c + a.n <= {room} WHERE NOT a.big AND NOT b.big GROUP BY ALL),
{name}_w AS (
  SELECT h.k, h.i AS lo, h.i AS f, h.h AS hi, h.e FROM {name}_h h JOIN {name}_c c ON c.k = h.k AND c.i = h.i WHERE c.n_before IS NULL OR c.n_before > {target}
  UNION ALL SELECT x.k, x.lo, x.f, greatest(x.f, h.h), x.e
  FROM (SELECT w.k, w.e, w.hi + 1 AS f, least(w.hi + 1, greatest(w.lo + 1, coalesce(m.m, w.hi + 1))) AS lo FROM {name}_w w LEFT JOIN {name}_m m ON m.k = w.k AND m.i = w.hi WHERE w.hi < w.e) x
  JOIN {name}_h h ON h.k = x.k AND h.i = x.lo),
{name} AS (SELECT w.k, w.f AS a, 0 AS b, string_agg(c.t, {joiner} ORDER BY c.i) AS t FROM {name}_w w JOIN {name}_c c ON c.k = w.k AND c.i BETWEEN w.lo AND w.hi GROUP BY w.k, w.f{oversized if cut else ''})"""


def with_runts(name: str, source: str, least: int) -> str:
    """``source(doc_id, a, b, c, t)`` to ``name(doc_id, ordinal, text, token_count)``: pieces under ``least`` words join the one before."""
    return f"""{name}_n AS (SELECT doc_id, t, row_number() OVER o AS nth, sum(CASE WHEN {n_words('t')} >= {least} THEN 1 ELSE 0 END) OVER o AS g, first_value({n_words('t')} >= {least}) OVER o AS starts FROM {source} WINDOW o AS (PARTITION BY doc_id ORDER BY a, b, c)),
{name}_g AS (SELECT doc_id, CASE WHEN starts THEN g ELSE g + 1 END AS g, string_agg(t, E'\\n\\n' ORDER BY nth) AS text FROM {name}_n GROUP BY ALL),
{name}_k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS ordinal, text, {n_words('text')} AS token_count, count(*) OVER (PARTITION BY doc_id) AS n FROM {name}_g),
{name} AS (SELECT doc_id, ordinal, text, token_count FROM {name}_k WHERE n > 1 OR token_count >= {least})"""


def fixed(target: int, overlap: int, least: int) -> str:
    """CTEs up to ``chunks(doc_id, ordinal, text, token_count)`` of whole documents, whose lines are sections."""
    return f"""whole AS (SELECT doc_id AS k, array_to_string(string_split(text, chr(10)), E'\\n\\n') AS t FROM documents),
{sentences('s', 'whole')},
{windows('p', 's', target, overlap)},
pieces AS (SELECT k AS doc_id, a, b, 0 AS c, t FROM p),
{with_runts('chunks', 'pieces', least)}"""


def structure(target: int, overlap: int, least: int) -> str:
    """The same with lines as sections: small neighbours share a chunk, large ones are packed alone."""
    return f"""line AS (SELECT doc_id, i, trim(x, {_ENDS}) AS t FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
body AS (SELECT doc_id AS k, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i, t, {n_words('t')} AS n FROM line WHERE t <> ''),
{windows('grp', 'body', target, 0, "E'\\n\\n'", cut=False)},
large AS (SELECT {{'d': k, 'i': i}} AS k, t FROM body WHERE n > {target}),
{sentences('s', 'large')},
{windows('p', 's', target, overlap)},
pieces AS (SELECT k AS doc_id, a, 0 AS b, 0 AS c, t FROM grp UNION ALL SELECT k.d, k.i, a, b, t FROM p),
{with_runts('chunks', 'pieces', least)}"""
