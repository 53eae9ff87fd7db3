"""The URL filter as DuckDB SQL, step by step as in `url_filter`."""

from __future__ import annotations

from foldspark.llm.url_filter import ALIKE, PRIOR_WEIGHT, REJECT_SHARE, RULES, SPREAD, TOP_SHARE


def judge_sql(levels: int = 6, pages: str = "pages") -> str:
    """SQL for the rows of `judge` with the registered query's rules, for paths of at most so many segments."""
    url = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"
    upper, lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
    cases = {"rule": [], "allow": []}
    for r in sorted(RULES, key=lambda r: (len(r.text), r.text), reverse=True):
        fits = f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        cases["rule"].append(f"{fits} THEN '{r.text}'")
        cases["allow"].append(f"{fits} THEN {r.allow}")
    sums = "CAST(sum(n) AS DOUBLE) AS n, CAST(sum(labelled) AS DOUBLE) AS labelled, CAST(sum(blocked) AS DOUBLE) AS blocked"

    def real(x: float) -> str:
        return f"CAST({x!r} AS DOUBLE)"

    def bound(n: str) -> str:
        return f"sqrt({real(SPREAD)} / {n})"

    def little(a: str, b: str) -> str:
        return f"{real(ALIKE)} * (1 / sqrt({a}) + 1 / sqrt({b}))"

    with_ = [
        f"parsed AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), {url}, 1), {upper}, {lower}) AS host, regexp_extract(coalesce(url, ''), {url}, 2) AS path FROM {pages})",
        f"judged AS (SELECT page_id, host, path, CASE {' '.join(cases['rule'])} END AS rule, CASE {' '.join(cases['allow'])} END AS allow FROM parsed)",
        "t0 AS (SELECT host, path, [s for s in string_split(path, '/') if s <> ''] AS parts, CAST(count(*) AS DOUBLE) AS n, count(allow) AS labelled, count(*) FILTER (NOT allow) AS blocked, '' AS template FROM judged GROUP BY host, path)",
    ]
    for k in range(1, levels + 1):
        top = real(TOP_SHARE)
        with_ += [
            f"c{k} AS (SELECT host, template, parts[{k}] AS part, sum(n) AS n FROM t{k - 1} WHERE len(parts) >= {k} GROUP BY ALL)",
            f"o{k} AS (SELECT host, template, sum(n) AS n, max(n) / sum(n) AS top FROM c{k} GROUP BY ALL)",
            f"p{k} AS (SELECT template, max(n) / sum(n) + {bound('sum(n)')} < {top} AS pooled FROM (SELECT template, part, sum(n) AS n FROM c{k} GROUP BY ALL) GROUP BY template)",
            f"v{k} AS (SELECT host, template, CASE WHEN top + {bound('n')} < {top} THEN true WHEN top - {bound('n')} >= {top} THEN false ELSE pooled END AS varies FROM o{k} JOIN p{k} USING (template))",
            f"t{k} AS (SELECT t.* EXCLUDE (template), t.template || CASE WHEN len(t.parts) < {k} THEN '' WHEN v.varies THEN '/*' ELSE '/' || t.parts[{k}] END AS template FROM t{k - 1} t LEFT JOIN v{k} v USING (host, template))",
        ]
    with_.append(f"m{levels + 1} AS (SELECT host, template, {sums}, template AS merged FROM t{levels} GROUP BY host, template)")

    def first(n: int) -> str:
        return f"array_to_string(list_slice(string_split(merged, '/'), 1, {n}), '/')"

    for k in range(levels, 0, -1):
        deep = f"len(string_split(merged, '/')) > {k}"
        labels = f"CASE WHEN greatest(x.l, h.l) = 0 THEN true WHEN least(x.l, h.l) = 0 THEN false ELSE abs(x.b / x.l - h.b / h.l) <= {little('x.l', 'h.l')} END"
        with_ += [
            f"d{k} AS (SELECT *, CASE WHEN {deep} THEN {first(k + 1)} END AS head, CASE WHEN {deep} THEN {first(k)} END AS parent, substr(merged, length({first(k + 1)}) + 1) AS tail FROM m{k + 1})",
            f"w{k} AS (SELECT host, parent, head, tail, {sums} FROM d{k} WHERE head IS NOT NULL GROUP BY ALL)",
            f"b{k} AS (SELECT host, parent, head, {sums} FROM w{k} GROUP BY ALL)",
            f"e{k} AS (SELECT host, parent, head, n, CASE WHEN labelled > 0 THEN labelled ELSE sum(labelled) OVER h END AS l, CASE WHEN labelled > 0 THEN blocked ELSE sum(blocked) OVER h END AS b FROM b{k} WINDOW h AS (PARTITION BY head))",
            f"u{k} AS (SELECT * FROM e{k} QUALIFY row_number() OVER (PARTITION BY host, parent ORDER BY n DESC, head) = 1)",
            f"s{k} AS (SELECT x.host, x.parent, x.head, sum(least(x.n / bx.n, y.n / h.n)) AS common FROM w{k} x JOIN b{k} bx USING (host, parent, head) JOIN u{k} h ON h.host = x.host AND h.parent = x.parent JOIN w{k} y ON y.host = x.host AND y.parent = x.parent AND y.head = h.head AND y.tail = x.tail GROUP BY ALL)",
            f"a{k} AS (SELECT x.host, x.head, h.head AS hub FROM e{k} x JOIN u{k} h ON h.host = x.host AND h.parent = x.parent AND h.head <> x.head LEFT JOIN s{k} s ON s.host = x.host AND s.parent = x.parent AND s.head = x.head WHERE round(1 - coalesce(s.common, 0), 9) <= {little('x.n', 'h.n')} AND {labels})",
            f"i{k} AS (SELECT host, head, hub || '|..' AS into_ FROM a{k} UNION SELECT host, hub, hub || '|..' FROM a{k})",
            f"m{k} AS (SELECT d.host, d.template, d.n, d.labelled, d.blocked, CASE WHEN d.head IS NULL THEN d.merged ELSE coalesce(i.into_, d.head) || d.tail END AS merged FROM d{k} d LEFT JOIN i{k} i USING (host, head))",
        ]
    w = real(PRIOR_WEIGHT)
    with_ += [
        "base AS (SELECT (coalesce(sum(blocked), 0) + 1) / (coalesce(sum(labelled), 0) + 2) AS base FROM m1)",
        f"priors AS (SELECT template, (sum(blocked) + {w} * (SELECT base FROM base)) / (sum(labelled) + {w}) AS prior FROM m1 GROUP BY template)",
        f"shares AS (SELECT host, merged, round((sum(blocked) + {w} * (sum(n * prior) / sum(n))) / (sum(labelled) + {w}), 6) AS blocked_share FROM m1 JOIN priors USING (template) GROUP BY host, merged)",
    ]
    verdict = f"CASE WHEN j.allow THEN 'allow' WHEN NOT j.allow THEN 'block' WHEN s.blocked_share >= {REJECT_SHARE} THEN 'block' ELSE 'allow' END"
    return (
        f"WITH {', '.join(with_)} SELECT j.page_id, j.host, j.path, j.rule, {verdict} AS verdict, m.merged AS template, s.blocked_share FROM judged j JOIN t{levels} t ON t.host = j.host AND t.path = j.path"
        " JOIN m1 m ON m.host = t.host AND m.template = t.template JOIN shares s ON s.host = m.host AND s.merged = m.merged"
    )
