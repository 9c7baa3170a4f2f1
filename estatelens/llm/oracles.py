"""SQL twins of the queries, for DuckDB on the same tables."""

from __future__ import annotations

from estatelens.llm import licenses, quality, secrets

_BLANKS = r"[\x20\x09-\x0D]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# --- licences ------------------------------------------------------------------
def _respelt(form: str, spellings: tuple[tuple[str, str], ...]) -> str:
    for spelling, one in spellings:
        form = f"regexp_replace({form}, {_text(spelling)}, {_text(one.replace('$1', chr(92) + '1'))}, 'g')"
    return form


def _forms(text: str) -> str:
    form = f"regexp_replace(lower({text}), {_text(licenses.COPYRIGHT)}, ' ', 'g')"
    form = f"regexp_replace({form}, {_text(licenses.PUNCTUATION)}, '  ', 'g')"
    form = f"(' ' || regexp_replace({form}, '\\n', ' ' || chr(10) || ' ', 'g') || ' ')"
    return _respelt(form, licenses.SPELLINGS + licenses.SPLIT_SPELLINGS)


def _one_line(forms: str) -> str:
    joined = f"(' ' || trim(regexp_replace({forms}, '[ \\n]+', '  ', 'g'), ' ') || ' ')"
    return f"trim(regexp_replace({_respelt(joined, licenses.SPLIT_SPELLINGS)}, ' +', ' ', 'g'), ' ')"


_KNOWN = ", ".join(f"({_text(name)}, {_text(text)})" for name, text in licenses.NOTICES)
_WHOLE = ", ".join(f"({_text(name)}, {_text(digest)})" for name, _, digest in licenses.WHOLE_TEXTS)
LICENSES = f"""
WITH known AS (
    SELECT digest, min(license) AS license FROM (
        SELECT license, sha256({_one_line(_forms('text'))}) AS digest FROM (VALUES {_KNOWN}) AS v(license, text)
        UNION ALL FROM (VALUES {_WHOLE}) AS w(license, digest)
    ) GROUP BY 1
), formed AS (
    SELECT rowid AS r, doc_id, {_forms("coalesce(text, '')")} AS forms
    FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), lines AS (
    SELECT r, regexp_replace(trim(unnest(string_split(forms, chr(10))), ' '), ' +', ' ', 'g') AS form FROM formed
), stated AS (
    SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
    FROM lines JOIN known ON sha256(form) = digest GROUP BY r
)
SELECT f.doc_id, f.digest, k.license, coalesce(s.notices, '') AS notices,
       CAST(coalesce(s.n, 0) AS BIGINT) AS n_notices
FROM (SELECT r, doc_id, sha256({_one_line('forms')}) AS digest FROM formed) f
LEFT JOIN known k ON k.digest = f.digest LEFT JOIN stated s ON s.r = f.r
"""


# --- quality -------------------------------------------------------------------
_RULES = " OR ".join(f"coalesce({r.reject}, false)" for r in quality.RULES)
_BASE = " OR ".join(f"({r.reject})" for r in quality.BASE_RULES)
QUALITY = rf"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), cut AS (
    SELECT r, doc_id, text,
           list_filter(regexp_split_to_array(text, '{_BLANKS}'), lambda w: w <> '') AS words,
           list_filter(string_split(text, chr(10)), lambda l: regexp_replace(l, '{_BLANKS}', '', 'g') <> '') AS lines
    FROM texts
), windows AS (
    SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
    FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM cut)
), again AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM windows) WHERE c > 1
), covered AS (
    SELECT r, count(DISTINCT i + d) AS n FROM again, (VALUES (0), (1), (2)) AS v(d) GROUP BY r
), counted AS (
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
           CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
           CAST(length(text) - length(regexp_replace(text, '[{quality.SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(lines) AS BIGINT) AS n_lines,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
           length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
    FROM cut LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({_BASE}) AS base_failed, NOT ({_BASE}) AND NOT ({_RULES}) AS kept
FROM counted
"""


# --- secrets -------------------------------------------------------------------
_ALL = secrets.BASE + secrets.WEAK


def _matches(number: int, kind: secrets.Kind) -> str:
    pattern = _text(kind.pattern)
    return f"""
    SELECT r, {number} AS kind, '{kind.role}' AS role, '{kind.name}' AS name,
           sum(length(gap) + length(whole)) OVER (PARTITION BY r ORDER BY i) - length(whole) AS start,
           sum(length(gap) + length(whole)) OVER (PARTITION BY r ORDER BY i) AS stop, length(value) AS worth
    FROM (
        SELECT r, i, gaps[i] AS gap, wholes[i] AS whole, vals[i] AS value
        FROM (SELECT r, gaps, wholes, vals, unnest(range(1, len(wholes) + 1)) AS i FROM (
            SELECT r, regexp_split_to_array(text, {pattern}) AS gaps,
                   regexp_extract_all(text, {pattern}) AS wholes,
                   regexp_extract_all(text, {pattern}, {kind.group}) AS vals FROM texts))
    )"""


_FITS = " OR ".join(f"(kind = {i} AND worth BETWEEN {k.least} AND {k.most})" for i, k in enumerate(_ALL))
_NEAR = " OR ".join(
    f"(w.role = '{role}' AND c.role IN ({', '.join(map(_text, others))}))"
    for role, others in secrets.COMPLEMENTS.items()
)
SECRETS = f"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), parts AS (
    SELECT * FROM ({" UNION ALL ".join(_matches(i, k) for i, k in enumerate(_ALL))}) WHERE {_FITS}
), linked AS (
    SELECT * FROM parts w WHERE kind < {len(secrets.BASE)} OR (
        EXISTS (SELECT 1 FROM parts c WHERE c.r = w.r AND ({_NEAR})
                AND c.start <= w.stop + {secrets.SCOPE} AND c.stop >= w.start - {secrets.SCOPE})
        AND NOT EXISTS (SELECT 1 FROM parts b WHERE b.r = w.r AND b.kind < {len(secrets.BASE)}
                        AND b.start < w.stop AND b.stop > w.start))
), told AS (
    SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
           count(*) FILTER (kind = 2) AS n_hex,
           string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind)
               FILTER (kind < {len(secrets.BASE)}) AS base,
           string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
    FROM linked GROUP BY r
)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM texts LEFT JOIN told USING (r)
"""


# --- vector codes --------------------------------------------------------------
def _codes(of: str, name: str) -> str:
    """The nearest entry of every part and its squared distance, from a codebook table."""
    return f"""{name} AS MATERIALIZED (
    SELECT r, part, min(d * 256 + entry) AS best FROM (
        SELECT x.r, x.part, b.entry, sum((x.x - b.x) * (x.x - b.x)) AS d
        FROM parts x JOIN {of} b ON b.part = x.part AND b.pos = x.pos GROUP BY 1, 2, 3
    ) GROUP BY 1, 2
)"""


def _next_book(before: str, codes: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (
    SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM {before} b LEFT JOIN (
        SELECT p.part, c.best % 256 AS entry, p.pos, CAST(floor(sum(p.x) / count(*)) AS BIGINT) AS x
        FROM parts p JOIN {codes} c ON c.r = p.r AND c.part = p.part GROUP BY 1, 2, 3
    ) m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos
)"""


_ROUNDS = ",\n".join(
    f"{_codes(f'book{i}', f'codes{i}')},\n{_next_book(f'book{i}', f'codes{i}', f'book{i + 1}')}" for i in range(4)
)
VECTOR_CODES = f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, embedding
    FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), parts AS MATERIALIZED (
    SELECT r, i // (len(embedding) // 4) AS part, i % (len(embedding) // 4) AS pos,
           CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * 1024) AS BIGINT) AS x
    FROM (SELECT r, embedding, unnest(range(len(embedding))) AS i FROM kept)
), book0 AS MATERIALIZED (
    SELECT part, r AS entry, pos, x FROM parts WHERE r < 256
), {_ROUNDS}, {_codes('book4', 'codes4')},
coded AS (
    SELECT r, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code,
           CAST(sum(best // 256) AS BIGINT) AS error
    FROM codes4 GROUP BY r
)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book4) AS codebooks_sha256
FROM kept k JOIN coded c ON c.r = k.r
"""


# --- substrings ----------------------------------------------------------------
SUBSTRINGS = r"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), places AS (
    SELECT r, doc_id, words, unnest(range(len(words))) AS i FROM texts
), windows AS (
    SELECT r, doc_id, i, words[i + 1] AS word,
           CASE WHEN i + 13 <= len(words) THEN array_to_string(words[i + 1 : i + 13], ' ') END AS passage
    FROM places
), first_ids AS (
    SELECT passage, min(doc_id) AS least_id FROM windows WHERE passage IS NOT NULL GROUP BY 1
), covered AS (
    SELECT w.r, w.i, w.word, coalesce(max(CASE WHEN f.least_id < w.doc_id THEN 1 ELSE 0 END)
        OVER (PARTITION BY w.r ORDER BY w.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS gone
    FROM windows w LEFT JOIN first_ids f ON f.passage = w.passage
), kept AS (
    SELECT r, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS text
    FROM covered GROUP BY r
)
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256, coalesce(k.text, '') AS text
FROM texts t LEFT JOIN kept k ON k.r = t.r
"""
