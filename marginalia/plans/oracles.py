"""What the queries must return, in SQL over the same tables (DuckDB dialect)."""

from __future__ import annotations

# --- relations the queries start from ---------------------------------------------------------

LINES = """lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
         (generate_subscripts(string_split(text, chr(10)), 1) - 1)::BIGINT AS i
  FROM documents)"""


def _file(n: str) -> str:
    return f"'src/d' || ({n}) % 97 || '/f' || ({n}) || '.' || (['go', 'ts', 'jsx', 'php', 'py', 'txt'])[({n}) % 6 + 1]"


FINDINGS = f"""{LINES},
marked AS (
  SELECT doc_id, i, text AS raw, doc_id + i AS n,
         (['doc', 'inline', 'trailing', 'annotation'])[(doc_id + i) % 4 + 1] AS kind,
         CASE WHEN (doc_id + i) % 19 = 0 THEN 'TODO ' ELSE '' END || text ||
         CASE WHEN (doc_id + i) % 23 = 0 THEN ' marginalia:ignore'
              WHEN (doc_id + i) % 29 = 0 THEN ' marginalia:ignore-next' ELSE '' END AS t
  FROM lines),
shaped AS (
  SELECT *, {_file('doc_id')} AS file,
         CASE kind WHEN 'doc' THEN '/** ' || t || chr(10) || ' */' WHEN 'inline' THEN '// ' || t
                   WHEN 'trailing' THEN '# ' || t ELSE '@param ' || t END AS comment_text,
         coalesce(lead(raw) OVER (PARTITION BY doc_id ORDER BY i), '') AS code_text
  FROM marked),
findings AS (
  SELECT *, i AS ord, (i + 1)::INTEGER AS line, (i + 1 + CASE WHEN kind = 'doc' THEN 1 ELSE 0 END)::INTEGER AS end_line,
         CASE WHEN kind IN ('doc', 'annotation') THEN file || ':' || (i // 8) ELSE '' END AS block,
         CASE WHEN kind = 'annotation' THEN 'a' || (i % 8) ELSE '' END AS slot,
         CASE WHEN kind IN ('doc', 'annotation') THEN '/** block ' || (i // 8) || ' */' ELSE '' END AS block_text,
         doc_id % 3 = 0 AS protected, doc_id % 11 = 0 AS required,
         sha256(comment_text || '|' || code_text) AS id,
         coalesce(lag(comment_text, 1) OVER w, '') LIKE '%marginalia:ignore-next%'
           OR coalesce(lag(comment_text, 2) OVER w, '') LIKE '%marginalia:ignore-next%' AS ignore_next
  FROM shaped WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""

# the blank characters of the engine's text functions, without and with the line feed
_H = r"[\t\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WS = _H[0] + r"\n" + _H[1:]

PROSE = rf"""{FINDINGS},
split AS (
  SELECT f.*, u.part, u.k FROM findings f,
    LATERAL (SELECT unnest(string_split(f.comment_text, chr(10))) AS part,
                    generate_subscripts(string_split(f.comment_text, chr(10)), 1) AS k) u),
opened AS (SELECT *, regexp_replace(part, '^{_WS}+|{_WS}+$', '', 'g') AS a FROM split),
stripped AS (SELECT *, CASE WHEN starts_with(a, '/**') THEN substr(a, 4) ELSE a END AS b FROM opened),
stripped2 AS (SELECT *, CASE WHEN starts_with(b, '/*') THEN substr(b, 3) ELSE b END AS c FROM stripped),
stripped3 AS (SELECT *, CASE WHEN ends_with(c, '*/') THEN left(c, length(c) - 2) ELSE c END AS d FROM stripped2),
stripped4 AS (SELECT *, CASE WHEN starts_with(d, '//') THEN substr(d, 3) ELSE d END AS e FROM stripped3),
stripped5 AS (SELECT *, CASE WHEN starts_with(e, '#') THEN substr(e, 2) ELSE e END AS g FROM stripped4),
stripped6 AS (SELECT *, CASE WHEN starts_with(g, '*') THEN substr(g, 2) ELSE g END AS h FROM stripped5),
prose AS (
  SELECT doc_id, i, kind, id, comment_text, ignore_next,
         regexp_replace(string_agg(regexp_replace(h, '^{_WS}+|{_WS}+$', '', 'g'), ' ' ORDER BY k),
                        '^{_WS}+|{_WS}+$', '', 'g') AS prose
  FROM stripped6 GROUP BY ALL)"""

# fixed values: prefixes that exempt a comment
_PREFIXES = (
    "TODO", "FIXME", "HACK", "XXX", "Copyright", "SPDX-License-Identifier", "@license", "@preserve", "!", "-*-", "vim:",
    "coding:", "coding=", "nolint", "go:", "phpcs:", "@phpstan-", "@psalm-", "{@inheritDoc}", "@inheritDoc", "eslint-",
    "@ts-", "prettier-ignore", "biome-ignore", "oxlint-", "tslint:", "jshint", "deno-", "istanbul ", "c8 ", "webpack",
    "sourceMappingURL", "sourceURL", "@jsx", "@flow", "@jest-", "@vitest-", "type: ignore", "noqa", "pragma:", "pylint:",
    "mypy:", "ruff:", "pyright:", "pyre-", "fmt:", "isort:", "yapf:", "nosec", "marginalia:",
)


def _disposition(kinds: str, baselined: str) -> str:
    exempt = " OR ".join(f"starts_with(lower(prose), '{p.lower()}')" for p in _PREFIXES)
    return f"""CASE WHEN kind NOT IN ({kinds}) THEN 'exempt' WHEN prose = '' OR {exempt} THEN 'exempt'
      WHEN kind <> 'annotation' AND length(prose) < 12 THEN 'exempt'
      WHEN contains(comment_text, 'marginalia:ignore') THEN 'suppressed' WHEN ignore_next THEN 'suppressed'
      WHEN {baselined} THEN 'baselined' ELSE 'kept' END"""


_ALL_KINDS = "'doc', 'inline', 'trailing', 'annotation'"
_KNOWN = "id IN (SELECT id FROM findings WHERE i % 7 = 3)"

VERDICTS = """numbers AS (
  SELECT *, doc_id * 31 + i * 7 AS m FROM findings),
graded AS (
  SELECT *, (m * 37 % 301)::DOUBLE / 100e0 AS acc, (m * 53 % 301)::DOUBLE / 100e0 AS use_,
         (m * 11 % 101)::DOUBLE / 100e0 AS acc_conf, (m * 13 % 101)::DOUBLE / 100e0 AS use_conf,
         (m * 17 % 101)::DOUBLE / 100e0 AS over_, (m * 19 % 101)::DOUBLE / 100e0 AS disabled,
         (doc_id % 500 + 100)::INTEGER AS input_tokens
  FROM numbers),
scored AS (
  SELECT *, round(100e0 * acc / 3e0)::INTEGER AS acc_pct, round(100e0 * use_ / 3e0)::INTEGER AS use_pct FROM graded)"""

LABELS = {
    "acc": "(['Fundamentally wrong', 'Materially misleading', 'Roughly correct', 'Accurate without material errors'])",
    "use_": "(['No information beyond the code', 'Marginal', 'Useful', 'Essential context'])",
}


def _results(error, warning, delete, use_warning, confidence, disabled, exported="true", docstrings="true",
             annotations="flag") -> str:
    keep = f"(required OR (protected AND CASE WHEN file LIKE '%.py' THEN {docstrings} ELSE {exported} END))"
    deciding = "CASE WHEN acc_pct <= use_pct THEN acc_conf ELSE use_conf END"
    off = "true" if disabled == "ignore" else "false"
    return f"""WITH {FINDINGS}, {VERDICTS},
decided AS (
  SELECT *, CASE
    WHEN disabled >= 0.7e0 AND {off} THEN 'keep||'
    WHEN disabled >= 0.7e0 AND {keep} THEN 'flag|warning|commented-out-code'
    WHEN disabled >= 0.7e0 THEN 'delete|warning|commented-out-code'
    WHEN {deciding} < {confidence}e0 THEN 'flag|info|low-confidence'
    WHEN kind <> 'doc' AND over_ >= 0.8e0 THEN 'flag|info|wide-scope'
    WHEN acc_pct <= {error} THEN 'flag|error|wrong-comment'
    WHEN use_pct <= {delete} AND kind = 'annotation' THEN '{annotations}|warning|redundant-annotation'
    WHEN use_pct <= {delete} AND {keep} THEN 'flag|warning|weak-comment'
    WHEN use_pct <= {delete} THEN 'delete|warning|useless-comment'
    WHEN acc_pct <= {warning} OR use_pct <= {use_warning} THEN 'flag|warning|weak-comment'
    ELSE 'keep||' END AS d
  FROM scored),
results AS (
  SELECT *, split_part(d, '|', 1) AS action, split_part(d, '|', 2) AS severity, split_part(d, '|', 3) AS rule FROM decided)"""


_DEFAULT = _results(30, 60, 15, 35, 0.5, "ignore")
_STRICT = _results(40, 70, 25, 45, 0.4, "delete")
_RULE_TEXT = """CASE rule WHEN 'wrong-comment' THEN 'comment does not describe the code'
  WHEN 'useless-comment' THEN 'comment says nothing the code does not'
  WHEN 'redundant-annotation' THEN 'annotation restates the code' WHEN 'weak-comment' THEN 'comment is weak on one axis'
  WHEN 'wide-scope' THEN 'comment is scoped wider than the code it pairs with'
  WHEN 'low-confidence' THEN 'verdict below the confidence threshold'
  WHEN 'commented-out-code' THEN 'comment is disabled code, not prose' ELSE rule END"""


def _snippet(column: str, limit: int) -> str:
    flat = rf"regexp_replace(regexp_replace({column}, '^{_WS}+|{_WS}+$', '', 'g'), '{_H}*\n{_H}*', ' ', 'g')"
    return f"CASE WHEN length({flat}) <= {limit} THEN {flat} ELSE substr({flat}, 1, {limit - 1}) || '…' END"


_MESSAGE = f"""CASE WHEN rule = 'commented-out-code'
  THEN {_RULE_TEXT} || ' (probability ' || round_even(100e0 * disabled, 0)::INTEGER || '%): ' || {_snippet('comment_text', 80)}
  ELSE {_RULE_TEXT} || ' (accuracy ' || acc_pct || '%, usefulness ' || use_pct || '%): ' || {_snippet('comment_text', 80)} END"""


def _bar(pct: str) -> str:
    return f"'[' || repeat('#', ({pct} * 10 // 100)::BIGINT) || repeat('-', (10 - {pct} * 10 // 100)::BIGINT) || ']'"


def _graded(name: str, pct: str, score: str) -> str:
    return (f"'    ' || rpad('{name}', 10, ' ') || ' ' || {_bar(pct)} || ' ' || lpad({pct}::VARCHAR, 3, ' ') || '%  ' || "
            f"{LABELS[score]}[round({score})::INTEGER + 1] || chr(10)")


_TEXT = f"""file || ':' || line || ':1: ' || upper(severity) || ' ' || CASE WHEN action = 'delete' THEN 'delete' ELSE 'flag' END
  || ' [' || rule || ']' || chr(10) || CASE WHEN rule = 'commented-out-code'
  THEN '    disabled   ' || {_bar('round(100e0 * disabled)::INTEGER')} || ' '
    || lpad(round(100e0 * disabled)::INTEGER::VARCHAR, 3, ' ') || '%  probability the comment is commented-out code' || chr(10)
  ELSE {_graded('accuracy', 'acc_pct', 'acc')} || {_graded('usefulness', 'use_pct', 'use_')} END
  || '    comment    ' || {_snippet('comment_text', 100)} || chr(10) || '    code       ' || {_snippet('code_text', 100)}
  || chr(10) || chr(10)"""

_XML_MESSAGE = """replace(replace(replace(replace(replace(replace(msg, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
  '"', '&#34;'), '''', '&#39;'), chr(9), '&#x9;')"""

# --- requests ------------------------------------------------------------------------------------

# fixed values: bytes of the default rubric's questions
_ACCURACY = len("""How accurately does the COMMENT describe the CODE between the >>> CODE and
<<< CODE markers? Use the surrounding CONTEXT only to resolve names and
intent, not as the thing being described.
""") + len(
    "Fundamentally wrong: describes different behavior, values, or intent than the marked code"
    "Materially misleading: partly right but a reader would draw a wrong conclusion"
    "Roughly correct: minor imprecision, nothing a reader would act on wrongly"
    "Accurate without material errors")
_USEFULNESS = len(
    "How much does the COMMENT tell a competent reader that the marked CODE does not already say?") + len(
    "No information beyond the code: restates the code or the signature, or states a type the code already states"
    "Marginal: a hint a reader could derive anyway, e.g. a unit, an expanded abbreviation, a section label"
    "Useful: explains a why, an invariant, an edge case, or a non-obvious effect"
    "Essential context: without it the code would be misread or misused")
_OVERREACH = len("The COMMENT describes behavior or purpose that lies outside the marked CODE, for example the whole "
                 "function or a later section.")
_DISABLED = len("""The COMMENT is source code switched off by commenting it out, rather than text
written for a reader. Prose that quotes code, names identifiers or shows a
usage example is not.
""")
_SUFFIX = """CASE WHEN slot <> '' THEN chr(10) || 'Answer only about the lines between >>> ' || upper(slot) || ' and <<< '
    || upper(slot) || ' in the COMMENT block.'
  WHEN block_text <> '' THEN chr(10) || 'Answer only about the COMMENT text outside the marked lines.' ELSE '' END"""
_QUESTION = f"""({_ACCURACY + _USEFULNESS + _OVERREACH} + octet_length(encode({_SUFFIX})) *
  CASE WHEN kind <> 'annotation' THEN 4 ELSE 3 END + CASE WHEN kind <> 'annotation' THEN {_DISABLED} ELSE 0 END)::INTEGER"""


def _state(context: str) -> str:
    return rf"""'--- CONTEXT ---' || chr(10) || CASE WHEN {context} <> '' THEN regexp_replace({context}, '\n+\z', '')
  ELSE '>>> CODE' || chr(10) || regexp_replace(code_text, '\n+\z', '') || chr(10) || '<<< CODE' END || chr(10)
  || '--- COMMENT ---' || chr(10) || regexp_replace(CASE WHEN block_text <> '' THEN block_text ELSE comment_text END,
     '\n+\z', '') || chr(10)"""


_ESTIMATE = "(floor({0}::DOUBLE / 3.6e0)::INTEGER + 250)"


def _requests(cap: int) -> str:
    size = _ESTIMATE.format("(p.size + n.growth)")
    return f"""WITH RECURSIVE {FINDINGS},
asked AS (SELECT *, {_QUESTION} AS growth, octet_length(encode({_state("''")})) AS state_bytes FROM findings),
singles AS (
  SELECT id AS req_id, count(*) AS n_findings, min(state_bytes + growth)::INTEGER AS size_bytes, false AS grouped
  FROM asked WHERE block = '' GROUP BY id),
members AS (
  SELECT *, row_number() OVER (PARTITION BY block ORDER BY ord) AS k,
         first_value(state_bytes) OVER (PARTITION BY block ORDER BY ord) AS state0
  FROM asked WHERE block <> ''),
packed AS (
  SELECT block, k, 0 AS bin, (state0 + growth)::BIGINT AS size, [slot] AS slots, state0 FROM members WHERE k = 1
  UNION ALL
  SELECT n.block, n.k,
         p.bin + CASE WHEN o.opens THEN 1 ELSE 0 END,
         CASE WHEN o.opens THEN n.state0 + n.growth ELSE p.size + o.adds END,
         CASE WHEN o.opens THEN [n.slot] ELSE list_append(p.slots, n.slot) END, n.state0
  FROM packed p JOIN members n ON n.block = p.block AND n.k = p.k + 1,
  LATERAL (SELECT CASE WHEN list_contains(p.slots, n.slot) THEN 0 ELSE n.growth END AS adds,
                  (floor((p.size + CASE WHEN list_contains(p.slots, n.slot) THEN 0 ELSE n.growth END)::DOUBLE / 3.6e0)
                   + 250) > {cap} AS opens) o),
grouped AS (
  SELECT block || '#' || bin AS req_id, count(*) AS n_findings, max(size)::INTEGER AS size_bytes, true AS grouped
  FROM packed GROUP BY block, bin),
requests AS (
  SELECT *, {_ESTIMATE.format('size_bytes')} AS est_tokens
  FROM (SELECT * FROM singles UNION ALL SELECT * FROM grouped))"""


_CACHE = f"""WITH {FINDINGS},
chosen AS (
  SELECT f.id, arg_min(f.doc_id, (f.doc_id, f.i)) AS d, arg_min(f.i, (f.doc_id, f.i)) AS i, arg_min(e.ts, (f.doc_id, f.i)) AS ts
  FROM findings f JOIN labels l ON l.doc_id = f.doc_id JOIN events e ON e.event_id = f.doc_id
  WHERE f.i % 2 = 0 GROUP BY f.id),
entries AS (
  SELECT CASE WHEN d % 4 = 0 THEN 'other' ELSE 'mine' END AS salt, id, (d + age) * 31 + i * 7 AS verdict_m,
         ts - age * INTERVAL 1 DAY AS stored
  FROM chosen, (SELECT unnest([0, 9]) AS age)),
newest AS (
  SELECT salt, id, max(stored) AS stored, arg_max(verdict_m, stored) AS verdict_m FROM entries GROUP BY salt, id)"""

# --- source text -----------------------------------------------------------------------------------

SOURCE_LINES = f"""{LINES},
typed AS (
  SELECT *, (['go', 'ts', 'php', 'py'])[doc_id % 4 + 1] AS lang, max(i) OVER (PARTITION BY doc_id) AS last_i,
         'd' || doc_id || '.' || (['go', 'ts', 'php', 'py'])[doc_id % 4 + 1] AS file,
         ([4, 2, 3, 2])[doc_id % 4 + 1] + i AS line,
         CASE WHEN doc_id % 4 = 3 THEN '# ' ELSE '// ' END AS mark,
         CASE WHEN doc_id % 4 IN (1, 2) THEN ';' ELSE '' END AS stop
  FROM lines),
source AS (
  SELECT *, 'call(' || i || ')' || stop AS call, mark || 'note ' || doc_id || ' ' || i AS note,
         CASE WHEN lang = 'go' THEN mark || text ELSE regexp_replace(mark || text, '[ \\t\\r]+\\z', '') END AS comment
  FROM typed)"""

PAIRS = f"""WITH {SOURCE_LINES},
pairs AS (
  SELECT file, line, 2 AS col, 'inline' AS kind, comment AS comment_text,
         CASE WHEN i = last_i THEN 'done()' || stop
              WHEN i + 1 = last_i THEN 'call(' || (i + 1) || ')' || stop
              ELSE 'call(' || (i + 1) || ')' || stop || chr(10) || chr(9) || 'call(' || (i + 2) || ')' || stop END AS code_text
  FROM source WHERE i % 4 = 0
  UNION ALL
  SELECT file, line, 3 + length(call), 'trailing', note, call FROM source WHERE i % 4 = 2)"""

_HEAD = """(['package p' || chr(10) || chr(10) || 'func f() {' || chr(10), 'function f() {' || chr(10),
  '<?php' || chr(10) || 'function f() {' || chr(10), 'def f():' || chr(10)])[doc_id % 4 + 1]"""
_TAIL = """chr(10) || chr(10) || chr(9) || 'done()' || stop || chr(10) || CASE WHEN lang = 'py' THEN '' ELSE '}' || chr(10) END"""

_DIFF = f"""WITH {SOURCE_LINES},
shown AS (
  SELECT file, lang, doc_id, i, last_i, stop, line,
         chr(9) || CASE i % 4 WHEN 0 THEN mark || text WHEN 2 THEN call || ' ' || note ELSE call END AS old_text,
         CASE WHEN i % 4 = 2 THEN chr(9) || call END AS new_text
  FROM source WHERE last_i >= 2),
framed AS (
  SELECT file, line, old_text, new_text FROM shown
  UNION ALL
  SELECT file, k, (string_split({_HEAD}, chr(10)))[k], NULL FROM (SELECT DISTINCT file, doc_id, lang, stop FROM shown),
    LATERAL (SELECT unnest([1, 2, 3]) AS k) WHERE k < ([4, 2, 3, 2])[doc_id % 4 + 1]
  UNION ALL
  SELECT file, ([4, 2, 3, 2])[doc_id % 4 + 1] + last_i + k, CASE k WHEN 1 THEN '' WHEN 2 THEN chr(9) || 'done()' || stop ELSE '}}' END, NULL
  FROM (SELECT DISTINCT file, doc_id, last_i, lang, stop FROM shown), LATERAL (SELECT unnest([1, 2, 3]) AS k)
  WHERE k < 3 OR lang <> 'py'),
bounds AS (
  SELECT file, greatest(min(CASE WHEN new_text IS NOT NULL THEN line END) - 3, 1) AS lo,
         least(max(CASE WHEN new_text IS NOT NULL THEN line END) + 3, max(line)) AS hi FROM framed GROUP BY file),
body AS (
  SELECT f.file, string_agg(CASE WHEN new_text IS NULL THEN ' ' || old_text
           ELSE '-' || old_text || chr(10) || '+' || new_text END, chr(10) ORDER BY line) AS text, lo, hi
  FROM framed f JOIN bounds b ON f.file = b.file AND f.line BETWEEN lo AND hi GROUP BY f.file, lo, hi)
SELECT file, md5('--- a/' || file || chr(10) || '+++ b/' || file || chr(10) || '@@ -' || lo || ',' || (hi - lo + 1) || ' +'
  || lo || ',' || (hi - lo + 1) || ' @@' || chr(10) || text || chr(10)) AS diff_md5 FROM body"""

ORACLES: dict[str, str] = {
    "comment_prose": f"WITH {PROSE} SELECT doc_id, i, prose, length(prose)::INTEGER AS chars FROM prose",
    "finding_identity": f"""WITH {FINDINGS} SELECT doc_id, i,
        left(sha256(comment_text || chr(0) || code_text || chr(0) || '3' || chr(0) || 'latest' || chr(0)), 32) AS finding_id
        FROM findings""",
    "path_language": """SELECT page_id, CASE (['go', 'TSX', 'mjs', 'php', 'pyi', 'md'])[page_id % 6 + 1]
        WHEN 'go' THEN 'go' WHEN 'TSX' THEN 'typescript' WHEN 'mjs' THEN 'javascript' WHEN 'php' THEN 'php'
        WHEN 'pyi' THEN 'python' ELSE '' END AS language FROM pages""",
    "path_globs": r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)
        SELECT page_id, regexp_matches(path, '^[^/]*/en/.*$') AS english,
          regexp_matches(path, '^(?:.*/)?[^/][^/][^/]$|^[^/]*\.example\.com/.*$') AS short_or_com,
          regexp_matches(path, '^(?:.*/)?[^/]*\.html$|^m\.[^/]*/.*$') AS html_or_mobile FROM p""",
    "binary_files": """SELECT doc_id, doc_id % 7 = 0 AND octet_length(encode(text)) < 8000 AS "binary" FROM documents""",
    "text_end_line": """SELECT doc_id, (1 + length(text) - length(replace(text, chr(10), '')))::INTEGER AS end_line
        FROM documents""",
    "axis_percent": f"""WITH {FINDINGS}, {VERDICTS} SELECT doc_id, i, acc_pct AS accuracy_pct,
        {LABELS['acc']}[round(acc)::INTEGER + 1] AS accuracy_label, use_pct AS usefulness_pct,
        {LABELS['use_']}[round(use_)::INTEGER + 1] AS usefulness_label FROM scored""",
    "request_cost": """WITH t AS (SELECT doc_id, (floor(octet_length(encode(text))::DOUBLE / 3.6e0)::INTEGER + 250) AS tokens
          FROM documents), s AS (SELECT *, (tokens // (doc_id % 7 + 1))::INTEGER AS share FROM t)
        SELECT doc_id, tokens, share, share::DOUBLE * (0.042e0 / 1e6) AS cost_usd FROM s""",
    "question_texts": f"WITH {FINDINGS} SELECT doc_id, i, {_SUFFIX} AS suffix, {_QUESTION} AS question_bytes FROM findings",
    "request_states": f"""WITH {FINDINGS}, s AS (SELECT doc_id, i,
        {_state("CASE WHEN i % 3 = 0 THEN code_text ELSE '' END")} AS state FROM findings)
        SELECT doc_id, i, md5(state) AS state_md5, octet_length(encode(state))::INTEGER AS state_bytes FROM s""",
    "snippets": f"SELECT doc_id, {_snippet('text', 80)} AS snippet FROM documents",
    "code_caps": """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
        k AS (SELECT *, array_to_string(parts[1:3], chr(10)) AS kept FROM l)
        SELECT doc_id, md5(CASE WHEN len(parts) > 3 THEN kept || chr(10) || '// ... cut' ELSE text END) AS capped_md5,
          octet_length(encode(CASE WHEN len(parts) > 3 THEN kept ELSE text END))::INTEGER AS kept_bytes FROM k""",
    "cache_salts": """SELECT DISTINCT user_id, CASE WHEN user_id % 5 = 0 THEN 'anonymous'
        ELSE left(sha256('key-' || user_id), 16) END AS salt FROM events""",
    "dispositions": f"""WITH {PROSE}, d AS (SELECT kind, {_disposition(_ALL_KINDS, _KNOWN)} AS disposition FROM prose)
        SELECT kind, disposition, count(*) AS n FROM d GROUP BY ALL""",
    "disposition_counts": f"""WITH {PROSE}, d AS (
        SELECT {_disposition("'doc', 'inline', 'trailing'", 'false')} AS disposition FROM prose)
        SELECT count(*) FILTER (disposition = 'exempt') AS exempt, count(*) FILTER (disposition = 'suppressed') AS suppressed,
          count(*) FILTER (disposition = 'baselined') AS baselined, count(*) FILTER (disposition = 'kept') AS kept FROM d""",
    "baseline_survivors": f"""WITH {PROSE} SELECT doc_id, i, id FROM prose
        WHERE {_disposition(_ALL_KINDS, _KNOWN)} = 'kept'""",
    "diff_hunks": rf"""WITH {LINES}, d AS (SELECT doc_id, i, CASE
          WHEN i % 9 = 0 THEN '+++ b/' || {_file('doc_id + i')}
          WHEN i % 3 = 1 THEN '@@ -1 +' || (i * 3 + doc_id % 7 + 1) || CASE WHEN (i + doc_id) % 4 = 1 THEN ''
            ELSE ',' || ((i + doc_id) % 4) END || ' @@ ctx' ELSE '+' || text END AS text FROM lines),
        f AS (SELECT *, last_value(CASE WHEN text LIKE '+++ b/%' THEN substr(text, 7) END IGNORE NULLS)
          OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS file FROM d),
        h AS (SELECT doc_id, file, regexp_extract(text, '^@@ -\S+ \+(\d+)(?:,(\d+))? @@', 1)::INTEGER AS s,
          coalesce(nullif(regexp_extract(text, '^@@ -\S+ \+(\d+)(?:,(\d+))? @@', 2), ''), '1')::INTEGER AS c
          FROM f WHERE text LIKE '@@%' AND file IS NOT NULL)
        SELECT doc_id, file, s AS start, s + c - 1 AS "end" FROM h WHERE c > 0""",
    "changed_line_findings": f"""WITH {FINDINGS}, r AS (SELECT {_file('doc_id')} AS file,
          (k * 5 + doc_id % 3 + 1) AS s, (k * 5 + doc_id % 3 + 1 + k) AS e
          FROM documents, (SELECT unnest([0, 1, 2]) AS k) WHERE doc_id % 5 <> 0)
        SELECT doc_id, i FROM findings f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.file = f.file)
          OR EXISTS (SELECT 1 FROM r WHERE r.file = f.file AND f.line <= r.e AND f.end_line >= r.s)""",
    "attached_verdicts": f"""WITH {FINDINGS}, a AS (SELECT id, arg_max(doc_id * 31 + i, (file, ord)) AS verdict
          FROM findings WHERE i % 3 <> 1 GROUP BY id)
        SELECT doc_id, i, verdict FROM findings JOIN a USING (id)""",
    "recorded_answers": f"""WITH {FINDINGS}, m AS (SELECT doc_id, i, CASE WHEN contains(comment_text, 'the') THEN 1
          WHEN contains(comment_text, 'de ') THEN 2 WHEN contains(comment_text, 'and') THEN 3 ELSE 4 END AS k FROM findings)
        SELECT doc_id, i, ([0.5e0, 2.5e0, 3e0, 2.7e0])[k] AS accuracy, ([1e0, 0.2e0, 3e0, 2.4e0])[k] AS usefulness,
          ([0.1e0, 0.3e0, 0.9e0, 0.05e0])[k] AS overreach, ([0.9e0, 0.9e0, 0.4e0, 0.93e0])[k] AS confidence FROM m""",
    "many_recorded_answers": f"""WITH {FINDINGS}, pairs AS (
          SELECT k, chr((97 + k * 7 % 26)::INTEGER) || chr((97 + (k * 11 + k // 26) % 26)::INTEGER) AS pair FROM range(676) r(k)),
        met AS (SELECT doc_id, i, min(k) AS k FROM findings JOIN pairs ON contains(comment_text, pair) GROUP BY doc_id, i)
        SELECT doc_id, i, coalesce((k % 301)::DOUBLE / 100e0, 3e0) AS accuracy FROM findings LEFT JOIN met USING (doc_id, i)""",
    "policy_default": f"{_DEFAULT} SELECT doc_id, i, action, severity, rule FROM results",
    "policy_strict": _results(40, 70, 25, 45, 0.4, "delete", exported="false", annotations="delete")
    + " SELECT doc_id, i, action, severity, rule FROM results",
    "policy_lenient": _results(20, 45, 8, 20, 0.65, "ignore", docstrings="false")
    + " SELECT doc_id, i, action, severity, rule FROM results",
    "result_summary": f"""{_STRICT} SELECT count(*) FILTER (severity = 'error') AS error,
        count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info,
        count(*) FILTER (action = 'delete') AS deleted,
        max(CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END) AS worst FROM results""",
    "rule_counts": f"""{_DEFAULT} SELECT rule, severity, action, count(*) AS findings, count(DISTINCT file) AS files,
        sum(input_tokens)::BIGINT AS input_tokens FROM results WHERE action <> 'keep' GROUP BY ALL""",
    "baseline_document": f"{_DEFAULT} SELECT id, rule FROM results WHERE action <> 'keep'",
    "deletions_per_file": f"""{_STRICT} SELECT file, count(*) AS deletions, min(line) AS first_line FROM results
        WHERE action = 'delete' GROUP BY file""",
    "severity_bars": f"""{_DEFAULT} SELECT doc_id, i,
        CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END AS rank,
        {_bar('acc_pct')} AS bar FROM results""",
    "report_text": f"{_STRICT} SELECT file, line, ord, {_TEXT} AS text FROM results WHERE action <> 'keep'",
    "report_github": f"""{_STRICT} SELECT file, line, ord, '::' || CASE WHEN severity = 'info' THEN 'notice' ELSE severity END
        || ' file=' || file || ',line=' || line || ',col=1,title=' || rule || '::' || {_MESSAGE} || chr(10) AS text
        FROM results WHERE action <> 'keep'""",
    "report_rdjson": f"""{_STRICT}, m AS (SELECT *, '{{"start":{{"line":' || line || ',"column":1}},"end":{{"line":' || line || ',"column":1}}}}' AS span
          FROM results WHERE action <> 'keep')
        SELECT file, line, ord, '    {{"message":' || to_json({_MESSAGE})::VARCHAR || ',"location":{{"path":' || to_json(file)::VARCHAR || ',"range":' || span
          || '}},"severity":"' || upper(severity) || '","code":{{"value":"' || rule || '"}}'
          || CASE WHEN action = 'delete' THEN ',"suggestions":[{{"range":' || span || ',"text":""}}]' ELSE '' END || '}}' AS text FROM m""",
    "report_sarif": f"""{_STRICT}, m AS (SELECT *, '"artifactLocation":{{"uri":' || to_json(file)::VARCHAR || '}}' AS artifact,
            '{{"startLine":' || line || ',"startColumn":1,"byteOffset":0,"byteLength":' || octet_length(encode(comment_text)) || '}}' AS region
          FROM results WHERE action <> 'keep')
        SELECT file, line, ord, '        {{"ruleId":"' || rule || '","level":"' || CASE severity WHEN 'info' THEN 'note' ELSE severity END
          || '","message":{{"text":' || to_json({_MESSAGE})::VARCHAR || '}},"locations":[{{"physicalLocation":{{' || artifact || ',"region":' || region || '}}}}]'
          || CASE WHEN action = 'delete' THEN ',"fixes":[{{"description":{{"text":"Delete the comment"}},"artifactChanges":[{{' || artifact
               || ',"replacements":[{{"deletedRegion":' || region || '}}]}}]}}]' ELSE '' END || '}}' AS text FROM m""",
    "report_checkstyle": f"""{_STRICT}, m AS (SELECT *, {_MESSAGE} AS msg,
          row_number() OVER (PARTITION BY file ORDER BY line, ord) = 1 AS opens,
          row_number() OVER (PARTITION BY file ORDER BY line DESC, ord DESC) = 1 AS closes
          FROM results WHERE action <> 'keep')
        SELECT file, line, ord, CASE WHEN opens THEN '  <file name="' || file || '">' || chr(10) ELSE '' END
          || '    <error line="' || line || '" column="1" severity="' || severity || '" message="' || {_XML_MESSAGE}
          || '" source="marginalia.' || rule || '"></error>' || chr(10)
          || CASE WHEN closes THEN '  </file>' || chr(10) ELSE '' END AS text FROM m""",
    "sarif_rules": f"""{_STRICT} SELECT rule, CASE arg_max(severity, (file, line, ord)) WHEN 'info' THEN 'note'
        ELSE arg_max(severity, (file, line, ord)) END AS level, any_value({_RULE_TEXT}) AS description
        FROM results WHERE action <> 'keep' GROUP BY rule""",
    "request_packing": f"{_requests(2000)} SELECT req_id, n_findings, size_bytes, est_tokens FROM requests",
    "split_requests": f"{_requests(900)} SELECT req_id, n_findings, size_bytes, est_tokens FROM requests",
    "token_total": f"{_requests(32000)} SELECT sum(est_tokens)::BIGINT AS est_tokens FROM requests",
    "budget_cut": f"""{_requests(32000)}, s AS (SELECT req_id, coalesce(sum(est_tokens) OVER (ORDER BY md5(req_id), req_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before FROM requests)
        SELECT req_id, spent_before, spent_before <= 1000000 AS within FROM s""",
    "cached_verdicts": f"""{_CACHE}, live AS (SELECT id, verdict_m FROM newest WHERE salt = 'mine'
          AND stored >= TIMESTAMP '2024-01-21 00:00:00' - INTERVAL 20 DAY)
        SELECT doc_id, i, verdict_m IS NOT NULL AS hit,
          round(100e0 * ((verdict_m * 37 % 301)::DOUBLE / 100e0) / 3e0)::INTEGER AS accuracy_pct
        FROM findings LEFT JOIN live USING (id)""",
    "cache_generations": f"""{_CACHE} SELECT salt, id, stored,
        round(100e0 * ((verdict_m * 53 % 301)::DOUBLE / 100e0) / 3e0)::INTEGER AS usefulness_pct FROM newest""",
    "scored_verdicts": f"""{_requests(32000)}, groups AS (
          SELECT id, file, ord, kind, block, comment_text, CASE WHEN block = '' THEN id ELSE block || '#0' END AS req_id FROM findings),
        judged AS (
          SELECT g.id, g.file, g.ord, g.kind, r.n_findings,
            CASE WHEN g.block = '' THEN contains(first_value(g.comment_text) OVER (PARTITION BY g.req_id ORDER BY g.file, g.ord), 'the')
                 ELSE false END AS said, g.slot_free
          FROM (SELECT *, true AS slot_free FROM groups) g JOIN requests r USING (req_id))
        SELECT id, arg_max(CASE WHEN said THEN 17 ELSE 83 END, (file, ord)) AS accuracy_pct,
          arg_max(CASE WHEN kind = 'annotation' THEN 0e0 WHEN said THEN 0.2e0 ELSE 0.4e0 END, (file, ord)) AS commented_out,
          arg_max((999 // n_findings)::INTEGER, (file, ord)) AS input_tokens
        FROM judged GROUP BY id""",
    "docblock_parts": rf"""WITH {LINES},
        body AS (SELECT doc_id, i + 1 AS k, CASE WHEN (i + doc_id) % 5 = 3 THEN ' * @param p' || i || ' ' || text
            WHEN (i + doc_id) % 7 = 6 THEN ' *' ELSE ' * ' || text END AS line FROM lines),
        block AS (SELECT * FROM body UNION ALL SELECT doc_id, 0, '/**' FROM documents
          UNION ALL SELECT doc_id, max(k) + 1, ' */' FROM body GROUP BY doc_id),
        facts AS (SELECT *, regexp_matches(line, '^\s*(?:/\*\*?)?\s*\*?\s*(@[A-Za-z][\w-]*)') AS tag,
            regexp_replace(regexp_replace(regexp_replace(line, '[ \t\r]+$', ''), '\*/$', ''), '[ \t]+$', '') AS kept,
            coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY k
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM block),
        states AS (SELECT *, NOT tag AND ltrim(kept, ' */' || chr(9)) = '' AS blank FROM facts),
        runs AS (SELECT *,
            coalesce(max(CASE WHEN tag THEN k END) OVER w, -1) AS last_tag,
            coalesce(max(CASE WHEN blank THEN k END) OVER w, -1) AS last_blank FROM states
          WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
        placed AS (SELECT *, last_tag >= 0 AND last_tag > last_blank AS inside FROM runs),
        tags AS (SELECT doc_id, last_tag AS k, row_number() OVER (PARTITION BY doc_id ORDER BY last_tag) AS slot,
            min(pos) AS line_pos, arg_min(length(line) - length(ltrim(line, ' */' || chr(9))), k) AS lead,
            max(pos + octet_length(encode(kept))) AS e, max(k) AS until,
            string_agg(line, chr(10) ORDER BY k) AS text, arg_max(line, k) AS last_line, arg_max(kept, k) AS last_kept
          FROM placed WHERE inside GROUP BY doc_id, last_tag),
        prose AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS text FROM placed WHERE NOT inside GROUP BY doc_id),
        marked AS (SELECT p.doc_id, string_agg(
            CASE WHEN o.slot IS NOT NULL THEN '>>> A' || o.slot || chr(10) ELSE '' END || line ||
            CASE WHEN c.slot IS NOT NULL THEN chr(10) || '<<< A' || c.slot ELSE '' END, chr(10) ORDER BY p.k) AS text,
            count(o.slot) AS n, sum(octet_length(encode(line)) + 1) - 1 AS size, min(o.line_pos) AS first_pos
          FROM placed p LEFT JOIN tags o ON o.doc_id = p.doc_id AND o.k = p.k
          LEFT JOIN tags c ON c.doc_id = p.doc_id AND c.until = p.k GROUP BY p.doc_id)
        SELECT doc_id, md5(CASE WHEN n > 0 THEN m.text ELSE '' END) AS marked_md5, '' AS slot, md5(p.text) AS text_md5,
          0 AS start, coalesce(first_pos, size)::INTEGER AS "end", 0 AS line
        FROM prose p JOIN marked m USING (doc_id) WHERE regexp_replace(p.text, '[/*\s]', '', 'g') <> ''
        UNION ALL
        SELECT doc_id, md5(m.text), 'a' || slot,
          md5(substr(left(t.text, length(t.text) - length(last_line) + length(last_kept)), (lead + 1)::BIGINT)),
          (line_pos + lead)::INTEGER, e::INTEGER, k::INTEGER FROM tags t JOIN marked m USING (doc_id)""",
    "paired_comments": f"""{PAIRS} SELECT file, line::INTEGER AS line, col::INTEGER AS "column", kind, comment_text, code_text,
        left(sha256(comment_text || chr(0) || code_text || chr(0) || '3' || chr(0) || 'latest' || chr(0)), 32) AS id,
        octet_length(encode(comment_text))::INTEGER AS comment_bytes FROM pairs""",
    "merged_comments": rf"""WITH {LINES}, t AS (SELECT *, (['go', 'js', 'php', 'py'])[doc_id % 4 + 1] AS lang, i // 5 AS run,
          max(i) OVER (PARTITION BY doc_id) AS last_i FROM lines)
        SELECT 'c' || doc_id || '.' || lang AS file, (([4, 2, 3, 2])[doc_id % 4 + 1] + min(i))::INTEGER AS line,
          (([4, 2, 3, 2])[doc_id % 4 + 1] + max(i))::INTEGER AS end_line,
          CASE WHEN lang IN ('js', 'php') THEN 'call();' ELSE 'call()' END
            || CASE WHEN max(i) + 1 = max(last_i) AND max(i) % 5 = 3
               THEN chr(10) || chr(9) || CASE WHEN lang IN ('js', 'php') THEN 'call();' ELSE 'call()' END ELSE '' END AS code_text,
          md5(CASE WHEN lang = 'go' THEN string_agg('// ' || text, chr(10) || chr(9) ORDER BY i)
              ELSE regexp_replace(string_agg(CASE WHEN lang = 'py' THEN '# ' ELSE '// ' END || text,
                chr(10) || chr(9) ORDER BY i), '[ \t\r]+\z', '') END) AS comment_md5
        FROM t WHERE i % 5 <> 4 GROUP BY doc_id, lang, run""",
    "file_status": f"""WITH {SOURCE_LINES} SELECT file, NOT (doc_id % 3 = 0 AND lang <> 'py') AS ok,
        CASE WHEN doc_id % 3 = 0 AND lang <> 'py' THEN 0 ELSE count(*) FILTER (i % 4 IN (0, 2)) END::INTEGER AS comments
        FROM source GROUP BY file, doc_id, lang""",
    "edited_files": f"""WITH {SOURCE_LINES} SELECT file, true AS ok, count(*) FILTER (i % 4 = 2)::INTEGER AS deleted,
        md5({_HEAD} || string_agg(chr(9) || CASE WHEN i % 4 = 0 THEN mark || text ELSE call END, chr(10) ORDER BY i) || {_TAIL})
          AS edited_md5
        FROM source GROUP BY file, doc_id, lang, stop HAVING count(*) FILTER (i % 4 = 2) > 0""",
    "file_diffs": _DIFF,
    "markup_comments": """SELECT 'm' || doc_id || '.tsx' AS file, (len(string_split(text, chr(10))) + 3)::INTEGER AS line,
        '// Keep ' || doc_id || ' in mind here' AS comment_text FROM documents""",
    "template_comments": r"""WITH l AS (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
        whole AS (
          SELECT doc_id, 'const t = ' || string_agg('`' || regexp_replace(text, '[`\\\\$]', '.', 'g') || ' ${ // Line ' || i || chr(10), '' ORDER BY i) || 'x'
            || repeat('}`', count(*)) || ';' AS code, count(*) AS n FROM l GROUP BY doc_id)
        SELECT 't' || doc_id || '.ts' AS file, (i + 1)::INTEGER AS line, '// Line ' || i AS comment_text, 'trailing' AS kind,
          md5(CASE WHEN n < 40 THEN code ELSE array_to_string(string_split(code, chr(10))[1:40], chr(10)) || chr(10) || '// ... truncated by marginalia' END) AS code_md5
        FROM l JOIN whole USING (doc_id)""",
    "nested_comments": f"""WITH {SOURCE_LINES}, deep AS (
          SELECT *, i % 5 + 1 AS depth, CASE WHEN lang = 'py' THEN i % 5 + 3 ELSE 2 * (i % 5) + 4 END AS height FROM source),
        placed AS (SELECT *, coalesce(sum(height) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM deep)
        SELECT 'n' || doc_id || '.' || lang AS file, (([4, 2, 3, 2])[doc_id % 4 + 1] + above + depth)::INTEGER AS line, (depth + 2)::INTEGER AS "column",
          'inline' AS kind, comment AS comment_text, 'call(' || i || ')' || stop AS code_text FROM placed""",
    "comment_contexts": f"""WITH {SOURCE_LINES},
        masked AS (
          SELECT file, doc_id, lang, stop, last_i, list_concat(
              [CASE lang WHEN 'go' THEN 'func f() {{' WHEN 'py' THEN 'def f():' ELSE 'function f() {{' END],
              list(chr(9) || CASE i % 4 WHEN 0 THEN '' WHEN 2 THEN call || ' ' ELSE call END ORDER BY i),
              ['', chr(9) || 'done()' || stop], CASE WHEN lang = 'py' THEN [] ELSE ['}}'] END) AS arr
          FROM source GROUP BY file, doc_id, lang, stop, last_i),
        spans AS (
          SELECT s.file, s.line, m.arr, m.stop, s.i, CASE WHEN s.i % 4 = 2 THEN s.i + 2 WHEN s.i = s.last_i THEN s.last_i + 4 ELSE s.i + 3 END AS a,
                 CASE WHEN s.i % 4 = 2 THEN s.i + 2 WHEN s.i = s.last_i THEN s.last_i + 4 WHEN s.i + 1 = s.last_i THEN s.i + 3 ELSE s.i + 4 END AS b
          FROM source s JOIN masked m USING (file) WHERE s.i % 4 IN (0, 2)),
        parts AS (
          SELECT *, list_concat(arr[greatest(1, a - 6):a - 1], [chr(9)]) AS head,
                 list_concat([rtrim(substr(arr[a], 2), ' ')], list_transform(arr[a + 1:b], lambda x: rtrim(x, ' '))) AS shown,
                 list_concat([CASE WHEN arr[b] LIKE '% ' THEN ' ' ELSE '' END], arr[b + 1:b + 5]) AS tail FROM spans),
        whole AS (
          SELECT *, list_concat(head[1:len(head) - 1], [chr(9) || '>>> CODE'], shown, ['<<< CODE'],
                                CASE WHEN array_to_string(tail, chr(10)) = '' THEN [] ELSE tail END) AS lines FROM parts)
        SELECT file, line::INTEGER AS line, array_to_string(CASE WHEN len(lines) <= 6 THEN lines
          ELSE lines[greatest(len(head) - 4, 0) + 1:greatest(len(head) - 4, 0) + 6] END, chr(10)) AS context FROM whole""",
    "sparse_diffs": f"""WITH {SOURCE_LINES},
        framed AS (
          SELECT file, line, chr(9) || CASE i % 4 WHEN 0 THEN mark || text WHEN 2 THEN call || ' ' || note ELSE call END AS old_text,
                 CASE i % 16 WHEN 2 THEN chr(9) || call END AS new_text, i % 16 = 8 AS removed FROM source
          UNION ALL
          SELECT file, k, (string_split({_HEAD}, chr(10)))[k], NULL, false FROM (SELECT DISTINCT file, doc_id FROM source),
            LATERAL (SELECT unnest([1, 2, 3]) AS k) WHERE k < ([4, 2, 3, 2])[doc_id % 4 + 1]
          UNION ALL
          SELECT file, ([4, 2, 3, 2])[doc_id % 4 + 1] + last_i + k, CASE k WHEN 1 THEN '' WHEN 2 THEN chr(9) || 'done()' || stop ELSE '}}' END, NULL, false
          FROM (SELECT DISTINCT file, doc_id, last_i, lang, stop FROM source), LATERAL (SELECT unnest([1, 2, 3]) AS k)
          WHERE k < 3 OR lang <> 'py'),
        marked AS (
          SELECT *, new_text IS NOT NULL OR removed AS changed, max(line) OVER (PARTITION BY file) AS lines,
                 max(CASE WHEN new_text IS NOT NULL OR removed THEN line END) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior,
                 coalesce(count(*) FILTER (removed) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM framed),
        numbered AS (
          SELECT *, count(*) FILTER (changed AND (prior IS NULL OR line - prior > 7)) OVER (PARTITION BY file ORDER BY line) AS hunk FROM marked),
        hunks AS (
          SELECT file, hunk, greatest(min(line) - 3, 1) AS lo, least(max(line) + 3, max(lines)) AS hi, count(*) FILTER (removed) AS taken
          FROM numbered WHERE changed GROUP BY file, hunk)
        SELECT n.file, h.hunk::INTEGER AS hunk, n.line::INTEGER AS line_no,
          CASE WHEN n.line = lo AND h.hunk = 1 THEN '--- a/' || n.file || chr(10) || '+++ b/' || n.file || chr(10) ELSE '' END
          || CASE WHEN n.line = lo THEN '@@ -' || lo || ',' || (hi - lo + 1) || ' +' || (lo - gone) || ',' || (hi - lo + 1 - taken) || ' @@' || chr(10) ELSE '' END
          || CASE WHEN removed THEN '-' || old_text WHEN new_text IS NULL THEN ' ' || old_text ELSE '-' || old_text || chr(10) || '+' || new_text END AS text
        FROM numbered n JOIN hunks h ON n.file = h.file AND n.line BETWEEN lo AND hi""",
    "duplicate_paths": """SELECT CASE WHEN count(*) OVER (PARTITION BY path) > 1 THEN '#' || substr(digest, 1, 12) || '/' ELSE '' END || path
          AS file, digest
        FROM (SELECT DISTINCT 'p' || (doc_id % 300) || '.go' AS path, sha256(text) AS digest FROM documents)""",
}
