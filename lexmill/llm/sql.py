"""What DuckDB SQL can say of this package's queries, on the same tables."""

from __future__ import annotations

from lexmill.llm import conversations, license_scan, quality, secret_scan

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

JACCARD_COMPONENTS = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n, sha256(string_agg(s, chr(10) ORDER BY s)) AS set_hash FROM sh GROUP BY doc_id),
rep AS (SELECT set_hash, min(doc_id) AS rep, min(n) AS n FROM n GROUP BY set_hash),
one AS (SELECT sh.* FROM sh JOIN rep ON rep.rep = sh.doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM one a JOIN one b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT p.a, p.b FROM pairs p JOIN rep x ON x.rep = p.a JOIN rep y ON y.rep = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(v, c) AS (SELECT rep, rep FROM rep UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.v),
comp AS (SELECT v, min(c) AS c FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN rep ON rep.set_hash = n.set_hash LEFT JOIN comp ON comp.v = rep.rep"""

REPEATED_PASSAGES = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM w WHERE len(w) >= 13)),
fst AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM win JOIN fst USING (k) WHERE m < doc_id),
wp AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k FROM wp ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept.k, '')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(generate_series(1, length({_DIGITS})), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN substr({_DIGITS}, i, 1)::INT ELSE (substr({_DIGITS}, i, 1)::INT * 2) % 10 + (substr({_DIGITS}, i, 1)::INT * 2) // 10 END)) % 10 = 0"
PERSONAL_DATA_COUNTS = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
  len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255)) = 0)) AS n_ip,
  len(list_filter(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN})) AS n_card,
  len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length({_DIGITS}) BETWEEN 8 AND 15)) AS n_phone FROM d"""


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _listed(words) -> str:
    return "[" + ", ".join(f"'{_quoted(w)}'" for w in words) + "]"


def quality_divergence() -> str:
    q, n_classes = quality, len(quality.CLASSES)
    # Classes are counted each on what the ones before leave; they share no character, so the order does not matter.
    counts = ", ".join(f"length(t) - length(regexp_replace(t, '[{_quoted(c)}]', '', 'g')) AS c{k}" for k, c in enumerate(q.CLASSES.values()))
    common = "CASE lang " + " ".join(f"WHEN '{lang}' THEN {_listed(words)}" for lang, words in q.COMMON_WORDS.items()) + " END"
    hits = ", ".join(f"len(list_filter(low, lambda x: x = common[{k + 1}])) AS h{k}" for k in range(10))
    shares = [f"c{k} / greatest(length, 1)" for k in range(n_classes)]
    words = [f"h{k} / greatest(n_words, 1)" for k in range(10)]
    p = [*shares, "greatest(0.0, 1 - (" + " + ".join(shares) + "))", *words, "greatest(0.0, 1 - (" + " + ".join(words) + "))"]
    half = lambda a, m: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / {m}) ELSE 0 END"

    def distance(ks):
        parts = " + ".join(f"{half(f'p{k}', f'((p{k} + r{k}) / 2)')} + {half(f'r{k}', f'((p{k} + r{k}) / 2)')}" for k in ks)
        return f"CASE WHEN r0 IS NULL THEN 0.0 ELSE sqrt(least(1.0, greatest(0.0, ({parts}) / 2))) END"

    cut = n_classes + 1
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN {tuple(q.COMMON_WORDS)} THEN lang ELSE 'other' END AS lang, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
wn AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
often AS (SELECT doc_id, i FROM wn QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rp AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY doc_id),
dl AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_WORD}') GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines, coalesce(rp.n, 0) AS n_repeat_words,
  length(t) AS length, list_transform(w, lambda x: lower(x)) AS low, {common} AS common, {counts} FROM d LEFT JOIN rp USING (doc_id) LEFT JOIN dl USING (doc_id)),
h AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {hits} FROM m),
s AS (SELECT *, {", ".join(f"{x} AS p{k}" for k, x in enumerate(p))} FROM h),
r AS (SELECT lang, {", ".join(f"avg(p{k}) AS r{k}" for k in range(len(p)))} FROM s WHERE n_words >= {q.GUARD_WORDS} AND NOT base_failed GROUP BY lang),
j AS (SELECT s.*, {distance(range(cut))} AS class_distance, {distance(range(cut, len(p)))} AS word_distance FROM s LEFT JOIN r USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance,
  NOT base_failed AND (n_words < {q.GUARD_WORDS} OR (class_distance <= {q.MAX_CLASS_DISTANCE} + {q.NOISE} / sqrt(greatest(n_words, 1)) AND word_distance <= {q.MAX_WORD_DISTANCE} + {q.NOISE} / sqrt(greatest(n_words, 1)))) AS kept FROM j"""


def license_blocks(percent: int = 80) -> str:
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, i AS p, '{label}' AS label FROM wi WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) for phrase, label in license_scan.PHRASES
    )
    import re

    terms = [(k, label, re.findall(_TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text))) for k, (label, text) in enumerate(license_scan.TEMPLATES)]
    templates = ", ".join(f"({k}, '{label}', {_listed(sorted(set(words)))}, {license_scan.block_step(len(words))})" for k, label, words in terms)
    return rf"""WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents), dw AS (SELECT doc_id, regexp_extract_all(t, '{_TERM}') AS w FROM d),
wi AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM dw),
ph AS ({phrases}),
b AS (SELECT doc_id, count(*) AS n_base, min(p) - 1 AS first_word, max(p) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM ph GROUP BY doc_id),
tp AS (SELECT k, label, words, len(words) AS m, s FROM (VALUES {templates}) v(k, label, words, s)), tw AS (SELECT k, label, m, s, unnest(words) AS x FROM tp),
ln AS (SELECT doc_id, unnest(a) AS l, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS a FROM d)),
lw AS (SELECT doc_id, i, regexp_extract_all(l, '{_TERM}') AS w FROM ln WHERE regexp_matches(l, '{_TERM}')),
lb AS (SELECT *, sum(CASE WHEN i - prev > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM lw)),
lp AS (SELECT doc_id, block, w, coalesce(sum(len(w)) OVER (PARTITION BY doc_id, block ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lb),
pw AS (SELECT doc_id, block, unnest(w) AS x, before + generate_subscripts(w, 1) - 1 AS p FROM lp),
bw AS (SELECT DISTINCT doc_id, block, s, p // s - o AS part, x FROM pw, (SELECT DISTINCT s FROM tp), (VALUES (0), (1)) v(o) WHERE p // s >= o),
hit AS (SELECT doc_id, label, count(*) / m AS share FROM bw JOIN tw USING (x, s) GROUP BY doc_id, block, part, k, label, m HAVING count(*) >= ceil({percent} * m / 100.0 - 1e-9)),
more AS (SELECT doc_id, label, share FROM hit UNION ALL SELECT doc_id, label, 1.0 FROM ph),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM more GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w) AS n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word, coalesce(b.base_labels, '') AS base_labels, coalesce(al.labels, '') AS labels, coalesce(al.score, 0.0) AS score FROM dw LEFT JOIN b USING (doc_id) LEFT JOIN al USING (doc_id)"""


def secrets() -> str:
    """Starts follow from the lengths of the matches and of what lies between them."""

    def listed(rank: str, kind: str, pattern: str, least: int) -> str:
        return rf"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, a AS "start", a + length(m) AS "end" FROM (
    SELECT doc_id, m, tail, sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS a FROM (
      SELECT doc_id, unnest(x) AS m, unnest(tails) AS tail, unnest(gaps[1:len(x)]) AS gap, generate_subscripts(x, 1) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, '{pattern}') AS x, regexp_extract_all(t, '{pattern}', 1) AS tails, string_split_regex(t, '{pattern}') AS gaps FROM d))
    WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE length(tail) >= {least}"""

    found = " UNION ALL ".join(
        listed(str(k), r.kind, _quoted(f"(?:{r.head.replace('(', '(?:')})({r.tail}+)"), r.least) for k, r in enumerate(secret_scan.RULES)
    )
    base = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE)
    one = """kind || ':' || "start" || ':' || "end\""""
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{r.kind}'), 0) AS n_{r.kind}" for r in secret_scan.BASE)
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
g AS (SELECT doc_id, {counts}, string_agg({one}, ',' ORDER BY "start", rank) FILTER (kind IN ({base})) AS base, string_agg({one}, ',' ORDER BY "start", rank) AS spans, count(*) FILTER (kind NOT IN ({base})) AS n_added FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added FROM d LEFT JOIN g USING (doc_id)"""


def conversation_repair() -> str:
    """Costs, edits and results of every suffix of a conversation, from its end, as (c, a, r) for each grammar state."""
    k, space = conversations, "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    none = "{'c': 1000000000::BIGINT, 'a': '', 'r': ''}"
    role = {"u": k.USER, "a": k.ASSISTANT}

    def then(cost, letter, line, state):
        return f"{{'c': {state}.c + {cost}, 'a': '{letter}' || {state}.a, 'r': {line} || {state}.r}}"

    def edits(q):
        to, own = f"s{k.NEXT[q]}", "chr(10) || role || ':' || text"
        kept = f"WHEN i = '{k.NEEDS[q]}' THEN {then('stay', 'K', own, to)}" + (f" WHEN i = 's' THEN {then('stay', 'K', own, 's1')}" if q == 0 else "")
        rerole = then(f"stay + {k.REROLE}", "R", f"chr(10) || '{role[k.NEEDS[q]]}:' || text", to)
        return f"list_min([{then(k.DELETE, 'D', repr(''), f's{q}')}, CASE WHEN gone THEN {none} ELSE {rerole} END, CASE WHEN gone THEN {none} {kept} ELSE {none} END])"

    def inserts(rows):
        """Two rounds, as no more than two inserts follow one another."""
        for _ in range(2):
            options = ", ".join(f"list_min([e{q}, {then(k.INSERT, 'I', f'chr(10) || {role[k.NEEDS[q]] + chr(58)!r}', f's{k.NEXT[q]}')}]) AS s{q}" for q in range(4))
            rows = f"SELECT * EXCLUDE (s0, s1, s2, s3), {options} FROM ({rows})"
        return rows

    def settled(rows):
        return inserts(f"SELECT *, {', '.join(f'e{q} AS s{q}' for q in range(4))} FROM ({rows})")

    last = ", ".join(f"{none if q not in k.FINAL else none.replace('1000000000', '0')} AS e{q}" for q in range(4))
    states = ", ".join(f"s{q}" for q in range(4))
    step = f"SELECT conv_id, n, {', '.join(f'{edits(q)} AS e{q}' for q in range(4))} FROM (SELECT x.conv_id, x.n, x.role, x.text, x.i, x.gone, x.stay, {', '.join(f'b.s{q}' for q in range(4))} FROM best b JOIN x ON x.conv_id = b.conv_id AND x.n = b.n + 1)"
    bits = "flatten(list_transform(generate_series(1, length(name)), lambda p: [unicode(substr(name, p, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return rf"""WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
k AS (SELECT *, xor(list_reduce({bits}, lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT), 4294967295) % 20 AS kind FROM t),
d AS (SELECT conv_id, turn, copy, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, (VALUES (1), (2)) v(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p FROM d),
f AS (SELECT *, substr(role, 1, 1) AS i, right(rtrim(text, {space}), 1) AS shown, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again FROM o),
x AS (SELECT *, shown = '' OR again AS gone, CASE WHEN shown NOT IN ('.', '!', '?') THEN {k.TRUNCATED} ELSE 0 END AS stay, lag(i) OVER w || i AS met, row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) AS n FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (shown = '') AS blank, count(*) FILTER (shown <> '' AND again) AS duplicate,
  count(*) FILTER (NOT gone AND stay > 0) AS truncated, count(*) FILTER (met NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM x GROUP BY conv_id),
best AS (SELECT conv_id, n, {states} FROM ({settled(f"SELECT DISTINCT conv_id, 0::BIGINT AS n, {last} FROM x")})
  UNION ALL SELECT conv_id, n, {states} FROM ({settled(step)}))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(substr(s0.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g USING (conv_id) LEFT JOIN best b ON b.conv_id = g.conv_id AND b.n = g.n"""
