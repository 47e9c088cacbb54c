"""DuckDB SQL for the training-text queries that SQL can express."""

#: One step a piece: the lines it repeats, where it is full and where its last blank line lies, from the lengths and running
#: lengths of an item's lines (lists count from 1, lines from 0).
_PIECES = """
WITH RECURSIVE item AS (
  SELECT id, greatest(coalesce(start_line, 1), 1) AS base, string_split(source_code, chr(10)) AS ls FROM (SELECT DISTINCT id, start_line, source_code FROM components WHERE length(source_code) > 1500)
), line AS (SELECT id, base, len(ls) AS n, list_transform(ls, lambda x: length(x)) AS size, list_transform(ls, lambda x: NOT regexp_matches(x, '[^\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]')) AS blank,
    list_transform(range(0, len(ls) + 1), lambda k: coalesce(list_sum(list_transform(ls[:k], lambda x: length(x) + 1)), 0)) AS cum FROM item
), r AS (
  SELECT id, 0 AS upto, 0 AS held, -1 AS first, -1 AS last, 0 AS parts, 0 AS made FROM line
  UNION ALL
  SELECT id, CASE WHEN long THEN upto + 1 ELSE stop + 1 END, CASE WHEN long THEN 0 ELSE stop + 1 - f END, CASE WHEN long THEN upto ELSE f END, CASE WHEN long THEN upto ELSE stop END,
    CASE WHEN long THEN CAST(ceil(size[upto + 1] / 1500.0) AS INT) ELSE 1 END, made + parts
  FROM (
    SELECT *, CASE WHEN full_at >= n - 1 THEN full_at ELSE coalesce(list_max(list_filter(range(upto + 1, full_at + 1), lambda k: blank[k + 1] AND k > list_min(list_filter(range(upto, full_at + 1), lambda j: NOT blank[j + 1])))), full_at) END AS stop
    FROM (
      SELECT *, len(list_filter(cum, lambda c: c <= cum[f + 1] + 1501)) - 2 AS full_at
      FROM (
        SELECT r.id, r.upto, r.parts, r.made, line.n, line.size, line.blank, line.cum, line.size[r.upto + 1] > 1500 AS long,
          CASE WHEN r.held >= 2 AND line.cum[r.upto + 2] - line.cum[r.upto - 1] <= 1501 THEN r.upto - 2 WHEN r.held >= 1 AND line.cum[r.upto + 2] - line.cum[r.upto] <= 1501 THEN r.upto - 1 ELSE r.upto END AS f
        FROM r JOIN line ON line.id = r.id WHERE r.upto < line.n)))
)
SELECT id, CAST(made + k AS INT) AS piece_no, CAST(base + first AS INT) AS start_line, CAST(base + last AS INT) AS end_line
FROM (SELECT id, first, last, made, unnest(range(1, parts + 1)) AS k FROM r WHERE last >= 0) JOIN line USING (id)
"""

SQL: dict[str, str] = {"p5_found": _PIECES}
