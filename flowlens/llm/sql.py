"""DuckDB SQL of the text queries that SQL can express, written from the same rules, constants and cutoffs."""

from __future__ import annotations

from flowlens.llm import chunks, collocations, conversations, language, licenses, metric_tree, mixing, secrets
from flowlens.llm.quality_rules import LEVELS, RULES, SYMBOLS
from flowlens.llm.texts import BLANK_CHARS, BLANKS, LOWER, UPPER

WORD = r"[^\x20\x09-\x0D]"
DOCS = "docs AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chars(text: str) -> str:
    """A string of any ASCII characters."""
    return "(" + " || ".join(f"chr({ord(c)})" for c in text) + ")"


def _severity() -> str:
    rates = [f"{LEVELS} - ({' + '.join(f'({rate} >= {c})::INT' for c in ladder)})" for rate, ladder in RULES.values()]
    return f"least({', '.join(rates)})"


def quality_rules(risk: float = 0.05, error: float = 0.05) -> str:
    """op3: statistics by lists, windows by rows, cutoffs by exact binomial tails of each stratum and level."""
    count = lambda chars: f"length(t) - length(translate(t, '{chars}', ''))"
    tail = f"list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - CASE WHEN j > 0 THEN lgamma(j + 1) ELSE 0 END - CASE WHEN j < n THEN lgamma(n - j + 1) ELSE 0 END + j * ln({risk}) + (n - j) * ln(1 - {risk}))))"
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
      cut_up AS (SELECT r, doc_id, stratum, t, list_filter(regexp_split_to_array(t, '{BLANKS}'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM docs),
      places AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM cut_up),
      triples AS (SELECT r, i, x, lead(x, 1) OVER (PARTITION BY r ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY r ORDER BY i) AS z FROM places),
      twins AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS c FROM triples WHERE z IS NOT NULL),
      covered AS (SELECT r, count(DISTINCT i + o) AS n FROM twins, (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY r),
      stats AS (SELECT doc_id, stratum, t, len(w) AS n_words, length(regexp_replace(t, '{BLANKS}', '', 'g')) AS word_chars, {count(SYMBOLS)} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines, {count(UPPER)} AS n_upper, {count('!')} AS n_bangs FROM cut_up LEFT JOIN covered USING (r)),
      judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_severity()} AS severity FROM stats),
      known AS (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id HAVING min(quality) = max(quality)),
      good AS (SELECT stratum, any_value(severity) AS severity FROM judged JOIN known USING (doc_id) WHERE NOT base_failed GROUP BY stratum, t HAVING min(q) = 1 AND max(q) = 1),
      counted AS (SELECT stratum, level, count(*) AS n, sum((severity <= level)::INT)::BIGINT AS k, (SELECT count(DISTINCT stratum) FROM good) AS strata FROM good, (SELECT unnest(range(0, {LEVELS})) AS level) GROUP BY stratum, level),
      tested AS (SELECT stratum, level, max((CASE WHEN k <= n * {risk} THEN {tail} ELSE 1 END * strata > {error})::INT) OVER (PARTITION BY stratum ORDER BY level) AS bad FROM counted),
      chosen AS (SELECT stratum, max(level) AS level FROM tested WHERE bad = 0 GROUP BY stratum)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(severity > level, true) AS kept FROM judged LEFT JOIN chosen USING (stratum)"""


def mixing_walk() -> str:
    """op2: targets from running sums over sources, and the walk along each source document by document."""
    u = "(floor(h / 256)::DOUBLE + 0.5) / 4503599627370496.0"
    return f"""WITH RECURSIVE {DOCS},
      sized AS (SELECT r, doc_id, source, len(regexp_extract_all(t, '{WORD}+'))::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || t), 1, 15))::BIGINT AS h,
        1 - (length(t) - length(translate(t, {_chars(mixing.UNCLEAN)}, ''))) / greatest(length(translate(t, {_chars(BLANK_CHARS)}, '')), 1) AS clean FROM docs),
      keyed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ln(-ln({u})) - ln(greatest(clean * clean, 0.05)), h, r) AS j FROM sized),
      totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
      weighed AS (SELECT *, [{', '.join(map(str, mixing.WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}]::DOUBLE AS w, source_size * {mixing.MOST_EPOCHS} AS cap FROM totals),
      levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level FROM weighed WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      targets AS (SELECT source, source_size, CASE WHEN level * w > cap THEN cap::DOUBLE ELSE w * max(CASE WHEN level * w <= cap THEN level END) OVER () END AS target FROM levels),
      plan AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {mixing.MOST_EPOCHS}) ELSE 0 END::BIGINT AS epochs, target * {mixing.NEAR} AS near FROM targets),
      walk AS (SELECT source, CAST(0 AS BIGINT) AS j, target - epochs * source_size AS rest, near, CAST(0 AS BIGINT) AS extra FROM plan UNION ALL
        SELECT walk.source, d.j, CASE WHEN rest > near AND size <= rest THEN rest - size ELSE rest END, near, CASE WHEN rest > near AND size <= rest THEN 1 ELSE 0 END FROM walk JOIN keyed d ON d.source IS NOT DISTINCT FROM walk.source AND d.j = walk.j + 1),
      ends AS (SELECT source, arg_max(rest, j) AS rest, any_value(near) AS near FROM walk GROUP BY source),
      closing AS (SELECT d.source, min(d.j) AS j FROM keyed d JOIN walk ON d.source IS NOT DISTINCT FROM walk.source AND d.j = walk.j JOIN ends ON ends.source IS NOT DISTINCT FROM d.source WHERE extra = 0 AND ends.rest > ends.near AND size < 2 * ends.rest GROUP BY d.source)
      SELECT doc_id, size, source_size, target, size * (epochs + greatest(extra, (closing.j IS NOT NULL)::BIGINT)) AS taken
      FROM keyed d JOIN plan ON plan.source IS NOT DISTINCT FROM d.source JOIN walk ON walk.source IS NOT DISTINCT FROM d.source AND walk.j = d.j LEFT JOIN closing ON closing.source IS NOT DISTINCT FROM d.source AND closing.j = d.j"""


def repeated_chunks() -> str:
    """op7: the gear hash by lags, borders by windows, digests as the chunks themselves, runs by islands."""
    c = chunks
    gear = ", ".join(map(str, c.gear_table().tolist()))
    back, ahead = (f"min(h) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN {a} AND {b})" for a, b in ((f"{c.REACH} PRECEDING", "1 PRECEDING"), ("1 FOLLOWING", f"{c.REACH} FOLLOWING")))
    hashed = " + ".join(f"coalesce(lag(g, {k}) OVER (PARTITION BY r ORDER BY p), 0) * {1 << k}" for k in range(c.WINDOW))
    return f"""WITH RECURSIVE {DOCS}, gear AS (SELECT [{gear}] AS g),
      bytes AS (SELECT r, unnest(b) AS x, generate_subscripts(b, 1) AS p, len(b) AS n FROM (SELECT r, regexp_extract_all(hex(encode(t)), '..') AS b FROM docs WHERE t <> '')),
      summed AS (SELECT r, p, n, x, ({hashed}) % 4294967296 AS h FROM (SELECT *, (SELECT g FROM gear)[1 + ('0x' || x)::INT]::BIGINT AS g FROM bytes)),
      least_ones AS (SELECT r, p FROM (SELECT r, p, n, h, {back} AS lo, {ahead} AS hi FROM summed) WHERE p > {c.REACH} AND p <= n - {c.REACH} AND h <= lo AND h <= hi),
      close AS (SELECT DISTINCT r FROM (SELECT r, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS d FROM least_ones) WHERE d <= {c.REACH}),
      spaced(r, p) AS (SELECT r, min(p) FROM least_ones JOIN close USING (r) GROUP BY r UNION ALL SELECT s.r, min(l.p) FROM spaced s JOIN least_ones l ON l.r = s.r AND l.p > s.p + {c.REACH} GROUP BY s.r, s.p),
      marks AS (SELECT r, p FROM spaced UNION SELECT DISTINCT r, n FROM bytes UNION SELECT r, p FROM least_ones WHERE r NOT IN (SELECT r FROM close)),
      wide AS (SELECT r, p, coalesce(lag(p) OVER (PARTITION BY r ORDER BY p), 0) AS s FROM marks),
      cuts AS (SELECT r, least(s + {c.MOST} * (k + 1), p) AS e, s + {c.MOST} * k AS s FROM (SELECT *, unnest(range(0, (p - s + {c.MOST - 1}) // {c.MOST})) AS k FROM wide)),
      pieces AS (SELECT cuts.r, s, e, row_number() OVER (PARTITION BY cuts.r ORDER BY s) - 1 AS i, docs.doc_id, substr(hex(encode(t)), 2 * s + 1, 2 * (e - s)) AS x FROM cuts JOIN docs USING (r)),
      seen AS (SELECT x, min({{'u': doc_id IS NULL, 'd': doc_id, 'r': r, 'i': i}}) AS f FROM pieces GROUP BY x HAVING min(r) < max(r)),
      own AS (SELECT pieces.*, seen.f.d AS first_doc_id, seen.f.r = r AND seen.f.i = i AS is_first, i - row_number() OVER (PARTITION BY r ORDER BY i) AS island FROM pieces JOIN seen USING (x)),
      long AS (SELECT *, sum(e - s) OVER (PARTITION BY r, island) AS total, coalesce((is_first <> lag(is_first) OVER (PARTITION BY r, island ORDER BY i))::INT, 0) AS turn FROM own),
      parts AS (SELECT *, sum(turn) OVER (PARTITION BY r, island ORDER BY i) AS part FROM long WHERE total >= {c.RUN})
      SELECT min(doc_id) AS doc_id, min(s) AS "start", max(e) AS "end", count(*) AS n_chunks, arg_min(first_doc_id, i) AS first_doc_id, NOT bool_and(is_first) AS removable FROM parts GROUP BY r, island, part"""


def license_scan() -> str:
    """op8: words with two spaces between them, so that a match takes the spaces on both its sides; every rule is tried on every text."""

    def doubled(regex: str) -> str:
        return "[^ ]".join(part.replace(" ", "  ") for part in regex.split("[^ ]"))

    table = ",\n".join(f"({k}, {_quoted(label)}, {priority}, {score}, {_quoted(' ' + doubled(regex) + ' ')})" for k, (label, regex, priority, score) in enumerate(licenses.rules()))
    base = " UNION ALL ".join(f"SELECT r, i, '{label}' AS label FROM near WHERE " + " AND ".join(f"{'xyz'[k]} = '{w}'" for k, w in enumerate(phrase.split())) for phrase, label in licenses.BASE.items())
    return f"""WITH {DOCS}, rules(k, label, priority, score, regex) AS (VALUES {table}),
      lists AS (SELECT r, doc_id, regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM docs),
      near AS (SELECT r, i, x, lead(x) OVER (PARTITION BY r ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY r ORDER BY i) AS z FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM lists)),
      base AS ({base}),
      spaced AS (SELECT r, ' ' || array_to_string(w, '  ') || ' ' AS norm FROM lists WHERE len(w) > 0),
      hit AS (SELECT r, k, regexp_extract_all(norm, regex) AS hits, string_split_regex(norm, regex) AS gaps FROM spaced, rules WHERE regexp_matches(norm, regex)),
      flat AS (SELECT r, k, unnest(hits) AS x, unnest(gaps[:len(hits)]) AS g, generate_subscripts(hits, 1) AS i FROM hit),
      placed AS (SELECT r, k, sum(length(g) + length(x)) OVER (PARTITION BY r, k ORDER BY i) AS e, length(x) AS n FROM flat),
      found AS (SELECT r, label, priority, score, e - n AS s, e FROM placed JOIN rules USING (k)),
      kept AS (SELECT * FROM found a WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.r = a.r AND b.s <= a.s AND a.e <= b.e AND (b.priority > a.priority OR (b.priority = a.priority AND b.e - b.s > a.e - a.s)))),
      named AS (SELECT r, label, score FROM kept UNION ALL SELECT r, label, 0.9 FROM base),
      per AS (SELECT r, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (label <> 'unknown'), 'unknown') AS labels, max(score)::DOUBLE AS score FROM named GROUP BY r),
      of_base AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY r)
      SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(of_base.labels, '') AS base_labels, coalesce(per.labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
      FROM lists LEFT JOIN of_base USING (r) LEFT JOIN per USING (r)"""


def _crc32(text: str) -> str:
    """CRC-32 of a string of ASCII characters, byte by byte."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, {table}[1 + (xor(a, b) & 255)]::BIGINT)), 4294967295::BIGINT)"


def rank_profiles() -> str:
    """op9: n-grams by rows, profiles and texts ranked by windows, distances as whole numbers."""
    size, top = language.PROFILE, language.TOP
    return f"""WITH {DOCS},
      marked AS (SELECT r, doc_id, lang, doc_id IS NOT NULL AND {_crc32('doc_id::VARCHAR')} % 5 = 0 AS held, trim(regexp_replace(lower(t), '[^\\pL]+', ' ', 'g'), ' ') AS t FROM docs),
      letters AS (SELECT r, unnest(c) AS c, generate_subscripts(c, 1) AS p FROM (SELECT r, list_transform(regexp_extract_all(' ' || t || ' ', '.'), lambda x: unicode(x)::BIGINT) AS c FROM marked WHERE t <> '')),
      near AS (SELECT r, c, lead(c) OVER (PARTITION BY r ORDER BY p) AS d, lead(c, 2) OVER (PARTITION BY r ORDER BY p) AS e FROM letters),
      grams AS (SELECT r, c AS code FROM near WHERE c <> 32 UNION ALL SELECT r, (c << 21) | d FROM near WHERE d IS NOT NULL UNION ALL SELECT r, (c << 42) | (d << 21) | e FROM near WHERE e IS NOT NULL AND d <> 32),
      counts AS (SELECT r, code, count(*) AS n FROM grams GROUP BY r, code),
      learned AS (SELECT lang, code, sum(n) AS n FROM counts JOIN marked USING (r) WHERE NOT held AND lang IS NOT NULL GROUP BY lang, code),
      profile AS (SELECT lang, code, k FROM (SELECT lang, code, row_number() OVER (PARTITION BY lang ORDER BY n DESC, code) - 1 AS k FROM learned) WHERE k < {size}),
      best AS (SELECT r, code, k FROM (SELECT r, code, row_number() OVER (PARTITION BY r ORDER BY n DESC, code) - 1 AS k FROM counts) WHERE k < {top}),
      far AS (SELECT best.r, l.lang, sum(coalesce(abs(p.k - best.k), {size}))::BIGINT AS d, count(*) AS n FROM best CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.code = best.code GROUP BY best.r, l.lang),
      placed AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, lang) AS k, lead(d) OVER (PARTITION BY r ORDER BY d, lang) AS next FROM far)
      SELECT doc_id, held AS held_out, coalesce(placed.lang, 'und') AS lang_pred, CASE WHEN placed.lang IS NULL THEN 0 WHEN next IS NULL THEN 1 - d::DOUBLE / ({size} * n) WHEN next = 0 THEN 0 ELSE (next - d)::DOUBLE / next END::DOUBLE AS score
      FROM marked LEFT JOIN placed ON placed.r = marked.r AND k = 1"""


def secret_scan() -> str:
    """op10: fixed patterns, the Markov ratios trained from the same samples, and tokens outside fixed spans by their best stretch."""
    s = secrets
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    assign = f"({'|'.join(map(either, ('password', 'passwd', 'secret', 'token')))}|{either('api')}_?{either('key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    kinds = {"assign": assign, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "random": f"[{s.TOKEN_CHARS}]+"}
    good = {"assign": f"length(regexp_extract(x, {_quoted(assign)}, 2)) >= 6", "access": "length(x) >= 20", "hex": "length(x) >= 24", "random": f"length(x) >= {s.SHORTEST}"}
    flat = " UNION ALL ".join(f"SELECT r, {k} AS kind, unnest(h) AS x, unnest(g[:len(h)]) AS g, generate_subscripts(h, 1) AS i FROM (SELECT r, regexp_extract_all(t, {_quoted(p)}) AS h, string_split_regex(t, {_quoted(p)}) AS g FROM docs)" for k, p in enumerate(kinds.values()))
    keep = " ".join(f"WHEN kind = {k} THEN {c}" for k, c in enumerate(good.values()))
    dealt = lambda of, n: f"(('0x' || substr(md5('{of}-' || i), 1, 8))::BIGINT % {n})"
    drawn = lambda a, n: f"array_to_string(list_transform(range(0, {n}), lambda k: '{a}'[1 + ('0x' || substr(d, 2 * k + 1, 2))::INT % {len(a)}]), '')"
    part = lambda of, a, n: f"substr({of}, {a}, {n})"
    uuid = " || '-' || ".join(part("d", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    random = " UNION ALL ".join(f"SELECT {f} AS family, CASE i % {len(ks)} {' '.join(f'WHEN {j} THEN {uuid if a == "-" else drawn(a, n)}' for j, (a, n) in enumerate(ks))} END AS x FROM drawn" for f, ks in enumerate(s.FAMILIES))
    chosen = ", ".join(f"parts[1 + {dealt(f'part{k}', len(s.PARTS) + len(s.WORDS))}]" for k in range(5))
    long = drawn(s.DIGITS, 32)
    capital = lambda c: f"array_to_string(list_transform({c}, lambda p: upper(p[1]) || p[2:]), '')"
    digits = f"CASE i // 9 % 3 WHEN 0 THEN {drawn(s.DIGITS, 19)} WHEN 1 THEN {" || '-' || ".join(part(long, a, n) for a, n in ((1, 2), (5, 5), (11, 8), (20, 3)))} ELSE '20' || regexp_replace({part(long, 1, 12)}, '(..)(..)(..)(.*)', '\\1-\\2-\\3T\\4') END"
    joined = lambda sep: f"array_to_string(c, '{sep}')"
    styles = (joined("_"), joined("-"), capital("c"), f"upper({joined('_')})", joined("/"), joined(""), f"c[1] || {capital('c[2:]')}", f"{joined('/')} || '/' || c[1] || '-' || c[2]", digits)
    tails = " ".join(f"WHEN {k} THEN '{sep}'" for k, sep in s.TAILS.items())
    kind = lambda c: f"CASE WHEN {c} BETWEEN 97 AND 122 THEN 0 WHEN {c} BETWEEN 65 AND 90 THEN 1 WHEN {c} BETWEEN 48 AND 57 THEN 2 ELSE 3 END"
    share = f"CASE WHEN f.family < 0 THEN {s.BACKED} ELSE {s.BACKED_RANDOM} END::DOUBLE"
    return f"""WITH {DOCS}, words AS (SELECT {list(s.PARTS + s.WORDS)} AS parts),
      drawn AS (SELECT i, sha256('a-' || i) || sha256('b-' || i) AS d, ([{chosen}])[:i // 9 % 4 + 2] AS c FROM words, range(0, {s.SAMPLES}) t(i)),
      samples AS ({random} UNION ALL SELECT -1, CASE i % 9 {' '.join(f'WHEN {k} THEN {x}' for k, x in enumerate(styles))} END || CASE WHEN {dealt('numbered', 3)} = 0 THEN coalesce(CASE i % 9 {tails} END || {dealt('number', 2030)}, '') ELSE '' END FROM drawn),
      steps AS (SELECT family, ascii(x[k]) AS a, ascii(x[k + 1]) AS b FROM samples, range(1, 300) t(k) WHERE k < length(x)),
      counts AS (SELECT family, a, b, {kind('a')} AS ka, {kind('b')} AS kb, count(*) AS n FROM steps GROUP BY family, a, b),
      own AS (SELECT family, a, sum(n) AS n FROM counts GROUP BY family, a), follow AS (SELECT family, ka, kb, sum(n) AS n FROM counts GROUP BY family, ka, kb), left_ AS (SELECT family, ka, sum(n) AS n FROM counts GROUP BY family, ka),
      codes AS (SELECT unnest(list_concat(range(65, 91), range(97, 123), range(48, 58), [43, 47, 95, 61, 45])) AS c), grid AS (SELECT x.c AS a, {kind('x.c')} AS ka, y.c AS b, {kind('y.c')} AS kb FROM codes x, codes y),
      parts AS (SELECT f.family, g.a, g.b, coalesce(c.n, 0) AS c, coalesce(o.n, 0) AS o, {share} * coalesce(o.n, 0) + 1.0::DOUBLE AS weight, (coalesce(w.n, 0) + 0.5::DOUBLE) / (coalesce(l.n, 0) + 2.0::DOUBLE) / [26, 26, 10, 5][1 + g.kb] AS backed
        FROM grid g CROSS JOIN (SELECT DISTINCT family FROM samples) f LEFT JOIN counts c ON c.family = f.family AND c.a = g.a AND c.b = g.b LEFT JOIN own o ON o.family = f.family AND o.a = g.a
        LEFT JOIN follow w ON w.family = f.family AND w.ka = g.ka AND w.kb = g.kb LEFT JOIN left_ l ON l.family = f.family AND l.ka = g.ka),
      chance AS (SELECT family, a, b, (c + weight * backed) / (o + weight) AS p FROM parts),
      ratio AS (SELECT p.family, p.a, p.b, least({s.MOST_STEP}, floor(ln(p.p / q.p) * {s.UNITS} + 0.5)::BIGINT) AS v FROM chance p JOIN chance q ON q.family = -1 AND q.a = p.a AND q.b = p.b WHERE p.family >= 0),
      flat AS ({flat}),
      placed AS (SELECT r, kind, x, sum(length(g) + length(x)) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM flat),
      good AS (SELECT r, kind, x, e - length(x) AS s, e FROM placed WHERE CASE {keep} END),
      base AS (SELECT * FROM good WHERE kind < 3),
      tokens AS (SELECT * FROM good g WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = g.r AND b.s <= g.s AND g.e <= b.e)),
      rated AS (SELECT r, s, e, family, k, sum(v) OVER (PARTITION BY r, s, e, family ORDER BY k) AS t FROM (SELECT *, unnest(range(1, length(x))) AS k FROM tokens) tokens JOIN ratio ON ratio.a = ascii(x[k]) AND ratio.b = ascii(x[k + 1])),
      stretch AS (SELECT r, s, e, family, t - least(0, coalesce(min(t) OVER (PARTITION BY r, s, e, family ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS t FROM rated),
      random AS (SELECT r, s, e FROM stretch GROUP BY r, s, e HAVING max(t - {list(s.THRESHOLDS)}[1 + family]) >= 0),
      spans AS (SELECT r, kind, s, e FROM base UNION ALL SELECT r, 3, s, e FROM random),
      said AS (SELECT *, {list(s.KINDS)}[1 + kind] || ':' || s || ':' || e AS x FROM spans),
      per AS (SELECT r, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, string_agg(x, ',' ORDER BY s, kind) FILTER (kind < 3) AS b, string_agg(x, ',' ORDER BY s, kind) AS a FROM said GROUP BY r)
      SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM docs LEFT JOIN per USING (r)"""


def top_products() -> str:
    """op11: every query against every row."""
    return f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({metric_tree.UNITS} * x::DOUBLE)::BIGINT) AS e
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
      pairs AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])), 0)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INT AS "rank" FROM pairs)
      SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 10"""


def phrases() -> str:
    """op12: every phrase at its place, counted by groups."""
    c = collocations
    return f"""WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
      pieces AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '{c.BREAKS}')) AS piece FROM docs)),
      places AS (SELECT lang, p, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM pieces),
      near AS (SELECT lang, x, lead(x, 1) OVER along AS y, lead(x, 2) OVER along AS z FROM places WINDOW along AS (PARTITION BY p ORDER BY i)),
      one AS (SELECT lang, x, count(*) AS f FROM near GROUP BY lang, x), total AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
      two AS (SELECT lang, x, y, count(*) AS f FROM near WHERE y IS NOT NULL GROUP BY lang, x, y HAVING count(*) >= {c.LEAST}),
      three AS (SELECT lang, x, y, z, count(*) AS f FROM near WHERE z IS NOT NULL GROUP BY lang, x, y, z HAVING count(*) >= {c.LEAST}),
      cuts AS (SELECT two.lang, two.x || ' ' || two.y AS phrase, two.f AS a, l.f AS l, r.f AS r, 1 AS k FROM two JOIN one l ON l.lang = two.lang AND l.x = two.x JOIN one r ON r.lang = two.lang AND r.x = two.y UNION ALL
        SELECT three.lang, three.x || ' ' || three.y || ' ' || three.z, three.f, l.f, r.f, 1 FROM three JOIN one l ON l.lang = three.lang AND l.x = three.x JOIN two r ON r.lang = three.lang AND r.x = three.y AND r.y = three.z UNION ALL
        SELECT three.lang, three.x || ' ' || three.y || ' ' || three.z, three.f, l.f, r.f, 2 FROM three JOIN two l ON l.lang = three.lang AND l.x = three.x AND l.y = three.y JOIN one r ON r.lang = three.lang AND r.x = three.z),
      rated AS (SELECT *, ({c.UNITS}::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
      lowest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
      held AS (SELECT two.lang, two.x || ' ' || two.y AS phrase FROM two JOIN three ON three.lang = two.lang AND ((three.x = two.x AND three.y = two.y) OR (three.y = two.x AND three.z = two.y)) WHERE 100 * three.f >= {c.INSIDE} * two.f),
      ranked AS (SELECT lowest.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS "rank" FROM lowest WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = lowest.lang AND h.phrase = lowest.phrase))
      SELECT lang, "rank", phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE "rank" <= {c.TOP}"""


def repaired_conversations() -> str:
    """op13: the edits by recursion from each conversation's last row, a struct (cost, edits, repaired rows) for each grammar state."""
    states = range(4)
    at = lambda c, a, r: f"{{'c': {c}, 'a': {a}, 'r': {r}}}"
    line = lambda role: f"chr(10) || {role} || ':' || text || "

    def edits(q: int) -> str:
        ways = [at(f"s{q}.c + {conversations.DELETE}", f"'D' || s{q}.a", f"s{q}.r")]
        for initial, to in conversations.ARCS[q].items():
            more = f"s{to}.c + (fault = 3)::INT * {conversations.TRUNCATED}"
            ways.append(f"CASE WHEN fault NOT IN (1, 2) AND x = '{initial}' THEN {at(more, f"'K' || s{to}.a", line('role') + f's{to}.r')} END")
            if initial in conversations.NAMES:
                said = f"'{conversations.NAMES[initial]}'"
                ways.append(f"CASE WHEN fault NOT IN (1, 2) THEN {at(f'{more} + {conversations.REROLE}', f"'R' || s{to}.a", line(said) + f's{to}.r')} END")
        return f"list_min([{', '.join(ways)}]) AS s{q}"

    def inserts(source: str) -> str:
        for _ in range(3):
            ways = {q: [f"s{q}", *(at(f"s{to}.c + {conversations.INSERT}", f"'I' || s{to}.a", f"chr(10) || '{conversations.NAMES[i]}:' || s{to}.r") for i, to in conversations.ARCS[q].items() if i in conversations.NAMES)] for q in states}
            source = f"SELECT conv_id, i, {', '.join(f'list_min([{", ".join(ways[q])}]) AS s{q}' for q in states)} FROM ({source})"
        return source

    start = ", ".join(f"{at(0 if q in conversations.ACCEPTS else 1_000_000_000, "''", "''")} AS s{q}" for q in states)
    step = f"SELECT paths.conv_id, paths.i - 1 AS i, {', '.join(edits(q) for q in states)} FROM paths JOIN judged ON judged.conv_id IS NOT DISTINCT FROM paths.conv_id AND judged.i = paths.i"
    return f"""WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS code FROM conversations),
      here AS (SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM raw, (SELECT unnest([0, 1]) AS copy) WHERE code <> 0 AND (copy = 0 OR code = 3)),
      placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 200), sha256(text)) AS i FROM here),
      judged AS (SELECT *, substr(role, 1, 1) AS x, CASE WHEN NOT regexp_matches(text, '{WORD}') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?]{BLANKS[:-1]}*\\z') THEN 3 ELSE 0 END AS fault FROM placed),
      near AS (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair FROM judged),
      per AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM near GROUP BY conv_id),
      paths AS ({inserts(f"SELECT conv_id, n AS i, {start} FROM per")} UNION ALL {inserts(step)})
      SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(substr(s0.r, 2), '')) AS repaired_sha256
      FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN per ON per.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN paths ON paths.conv_id IS NOT DISTINCT FROM c.conv_id AND paths.i = 0"""
