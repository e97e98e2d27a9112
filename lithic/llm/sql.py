"""SQL twins of the operators that SQL can express, for an outside engine (DuckDB)."""

from __future__ import annotations

from .mixing import DIGEST_BITS, Mixing
from .substrings import WINDOW

_p = Mixing()


def _doubled() -> str:
    """Steps that put 2, 4, 8, ... words together, and then a whole window of them (null where the text ends)."""
    steps, parts, size, at = [], [], 1, 0
    while 2 * size <= WINDOW:
        steps.append(f"w{2 * size} AS (SELECT *, w{size} || ' ' || lead(w{size}, {size}) OVER o AS w{2 * size} FROM w{size} WINDOW o AS (PARTITION BY t ORDER BY i))")
        size *= 2
    largest = size
    while size:
        if WINDOW & size:
            parts.append(f"lead(w{size}, {at}) OVER o")
            at += size
        size //= 2
    steps.append(f"windows AS (SELECT t, i, w1, {" || ' ' || ".join(parts)} AS seq FROM w{largest} WINDOW o AS (PARTITION BY t ORDER BY i))")
    return ", ".join(steps)


OP4 = f"""WITH texts AS (SELECT row_number() OVER () AS t, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w1 AS (SELECT t, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM texts),
{_doubled()},
marked AS (SELECT t, i, w1, seq IS NOT NULL AND count(*) OVER (PARTITION BY seq) > 1 AS again FROM windows),
judged AS (SELECT t, i, w1, bool_or(again) OVER (PARTITION BY t ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM marked),
kept AS (SELECT t, count(*) FILTER (gone) AS n, string_agg(w1, ' ' ORDER BY i) FILTER (NOT gone) AS rest FROM judged GROUP BY t)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (t)"""

#: Sources are numbered by name, null last. One row a slot is made from the one before: among the
#: sources whose next block is released, that of the earliest deadline, then of the smallest number.
OP9 = f"""WITH RECURSIVE documents_ AS MATERIALIZED (SELECT doc_id, source, greatest(coalesce(length(text), 0), 1) AS size,
  CAST('0x' || left(md5(concat_ws('|', '{_p.seed}', doc_id)), {DIGEST_BITS // 4}) AS BIGINT) AS digest FROM documents),
weights AS (SELECT source, row_number() OVER (ORDER BY source NULLS LAST) AS k, pow(sum(size), {_p.temper}) AS w FROM documents_ GROUP BY source),
exact AS (SELECT source, k, greatest(1.0::DOUBLE, w * {_p.period} / sum(w) OVER ()) AS x FROM weights),
scaled AS (SELECT source, k, x * ({_p.period} / sum(x) OVER ()) AS y FROM exact),
whole AS (SELECT source, k, y, greatest(1, CAST(floor(y) AS BIGINT)) AS n FROM scaled),
shares AS MATERIALIZED (SELECT source, k, n + CAST(row_number() OVER (ORDER BY floor(y) - y, k) <= {_p.period} - sum(n) OVER () AS BIGINT) AS share FROM whole),
slots(slot, made, pick) AS (
  SELECT -1::BIGINT, list(0::BIGINT ORDER BY k), NULL::BIGINT FROM shares
  UNION ALL
  SELECT slot, list_transform(made, lambda m, i: m + CAST(i = coalesce(pick, 0) AS BIGINT)), pick FROM (
    SELECT slot, made, list_min(list_transform(made, lambda m, i: CASE WHEN m < share[i] AND m * {_p.period} // share[i] <= slot
      THEN (((m + 1) * {_p.period} + share[i] - 1) // share[i]) * 1000000 + i END)) % 1000000 AS pick
    FROM (SELECT slot + 1 AS slot, made FROM slots WHERE slot < {_p.period - 1}), (SELECT list(share ORDER BY k) AS share FROM shares))),
places AS (SELECT pick AS k, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS j FROM slots WHERE pick IS NOT NULL),
starts AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY digest, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM documents_)
SELECT doc_id, s.source, CAST(size AS BIGINT) AS size, start // {_p.block} AS block,
  CAST(start // {_p.block} // share * {_p.period} + slot AS BIGINT) AS slot, start % {_p.block} AS place
FROM starts s JOIN shares h ON s.source IS NOT DISTINCT FROM h.source JOIN places p ON p.k = h.k AND p.j = start // {_p.block} % share"""

ORACLE_SQL = {"op4_substrings": OP4, "op9_mixing": OP9}
