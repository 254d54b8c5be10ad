"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from lociq.llm import line_dedup


def _level(name: str, above: str, parents: list[str], key: str, weight: str) -> str:
    """The steps that deal the budgets of ``above`` to the children ``key`` of each parent."""
    keys = ", ".join([*parents, key])
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    join = f"JOIN {above} USING ({', '.join(parents)})" if parents else f"CROSS JOIN {above}"
    order = f"{part} ORDER BY cap / weight, {key}"
    return f"""
{name}_nodes AS (
  SELECT {", ".join(f"n.{k}" for k in [*parents, key])}, cap, weight, budget AS above
  FROM (SELECT {keys}, sum(tokens * {{epochs}}) AS cap, {weight} AS weight FROM leaves GROUP BY {keys}) n {join}),
{name}_ranked AS (
  SELECT *, above - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
         sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM {name}_nodes),
{name}_full AS (SELECT *, cap * weights <= left_ * weight AS is_full FROM {name}_ranked),
{name}_open AS (
  SELECT *, above - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part}) AS rest,
         sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({part}) AS open_,
         sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM {name}_full),
{name} AS (
  SELECT {keys}, CASE WHEN is_full THEN cap ELSE (rest * upto) // open_ - (rest * (upto - weight)) // open_ END AS budget FROM {name}_open)"""


def mixing_steps(docs: str, share: tuple[int, int], epochs: int, seed: int) -> str:
    """WITH steps from a table of doc_id, text, lang and source to ``mixed``: doc_id, levels, epoch, take_tokens."""
    steps = [
        f"""
tokens_ AS (
  SELECT doc_id, CASE WHEN number = '' THEN 'other' WHEN number::INT % 2 = 0 THEN 'web' ELSE 'reference' END AS domain, lang, source, tokens
  FROM (SELECT doc_id, regexp_extract(coalesce(source, ''), '([0-9]{{{{1,9}}}})$', 1) AS number, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM {docs}) WHERE tokens > 0),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM tokens_ GROUP BY ALL),
top AS (SELECT least(sum(tokens) * {share[0]} // {share[1]}, sum(tokens * {{epochs}})) AS budget FROM leaves)""",
        _level("d", "top", [], "domain", "CASE domain WHEN 'web' THEN 3 WHEN 'reference' THEN 2 ELSE 1 END"),
        _level("l", "d", ["domain"], "lang", "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END"),
        _level("s", "l", ["domain", "lang"], "source", "CASE source WHEN 'src0' THEN 2 ELSE 1 END"),
        f"""
deals AS (SELECT domain, lang, source, budget // tokens AS full_, budget % tokens AS rest FROM leaves JOIN s USING (domain, lang, source)),
ordered AS (
  SELECT t.doc_id, domain, lang, source, t.tokens, full_, rest,
         coalesce(sum(t.tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(':', '{seed}', full_::BIGINT::VARCHAR, coalesce(doc_id::VARCHAR, ''))), doc_id, t.tokens
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_
  FROM tokens_ t JOIN deals USING (domain, lang, source)),
mixed AS (
  SELECT doc_id, domain, lang, source, unnest(range(full_::BIGINT)) AS epoch, tokens AS take_tokens FROM ordered WHERE full_ > 0
  UNION ALL
  SELECT doc_id, domain, lang, source, full_::BIGINT, least(tokens, rest - start_)::BIGINT FROM ordered WHERE rest > start_)""",
    ]
    return ",".join(steps).format(epochs=epochs)


def mixing_sql(share: tuple[int, int], epochs: int, seed: int = 7) -> str:
    return f"WITH {mixing_steps('documents', share, epochs, seed)}\nSELECT * FROM mixed"


def line_dedup_sql(ratio: float, min_pages: int) -> str:
    text = "html"
    for pattern, new in ((line_dedup.HIDDEN, "''"), (line_dedup.BLOCK, "chr(10)"), (line_dedup.TAG, "''")):
        text = f"regexp_replace({text}, '{pattern}', {new}, 'g')"
    return f"""
WITH pages_ AS (
  SELECT row_number() OVER () AS row_, page_id, {text} AS text,
         lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '')) AS host FROM pages),
{line_steps("pages_", "host", ratio, min_pages)}
SELECT page_id, host, n_lines, n_dropped, sha256(coalesce(new_text, '')) AS text_sha256 FROM deduped"""


def line_steps(table: str, host: str, ratio: float, min_pages: int) -> str:
    """WITH steps from a table with row_, text and a host to ``deduped``: its columns, n_lines, n_dropped, new_text."""
    trimmed = "trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))"
    return f"""
lines_ AS (
  SELECT *, string_split(text, chr(10)) AS lines, list_transform(string_split(text, chr(10)), lambda x: {trimmed}) AS keys FROM {table}),
totals AS (SELECT {host}, count(*) AS pages FROM {table} GROUP BY {host}),
counts AS (
  SELECT {host}, key, count(*) AS n FROM (SELECT DISTINCT row_, {host}, unnest(keys) AS key FROM lines_) WHERE key <> '' GROUP BY {host}, key),
drops AS (
  SELECT {host}, list(key) AS drops FROM counts JOIN totals USING ({host}) WHERE n >= {min_pages} AND n > {ratio} * pages GROUP BY {host}),
deduped AS (
  SELECT lines_.*, coalesce(len(list_filter(keys, lambda x: x <> '')), 0) AS n_lines,
         coalesce(len(list_filter(keys, lambda x: list_contains(coalesce(drops, []), x))), 0) AS n_dropped,
         CASE WHEN text IS NULL THEN NULL
              ELSE coalesce(array_to_string(list_filter(lines, lambda x: NOT list_contains(coalesce(drops, []), {trimmed})), chr(10)), '') END AS new_text
  FROM lines_ LEFT JOIN drops USING ({host}))"""


def quality_sql() -> str:
    """The ledger with the newest policy: all nine rules reject."""
    letters = lambda keep: f"length(regexp_replace(t, '[^{keep}]', '', 'g'))"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row_, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT row_, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
windows AS (
  SELECT row_, k, w[k] || chr(32) || w[k + 1] || chr(32) || w[k + 2] AS three FROM (SELECT row_, w, unnest(range(1, len(w) - 1)) AS k FROM parts)),
often AS (SELECT row_, three FROM windows GROUP BY ALL HAVING count(*) > 1),
repeated AS (
  SELECT row_, count(DISTINCT place) AS n FROM (SELECT row_, unnest([k, k + 1, k + 2]) AS place FROM windows JOIN often USING (row_, three)) GROUP BY row_),
ledger AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, {letters("#*$%&|<>")}::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
         {letters("A-Za-z")}::BIGINT AS n_letters, {letters("A-Z")}::BIGINT AS n_upper, {letters("!")}::BIGINT AS n_bangs, {letters("0-9")}::BIGINT AS n_digits
  FROM parts LEFT JOIN repeated USING (row_)),
bits AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_upper > 50 * n_letters THEN 64 ELSE 0 END + CASE WHEN 100 * n_bangs > 20 * n_words THEN 128 ELSE 0 END
    + CASE WHEN 100 * n_digits > 30 * word_chars THEN 256 ELSE 0 END)::BIGINT AS fail_bits FROM ledger)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, 2::BIGINT AS policy FROM bits"""
