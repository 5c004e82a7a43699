"""SQL for units, vectors, scores and chunks: the same results from other steps than the operators take.

Lists and numbers are written out here and not taken from the implementation.
"""

from __future__ import annotations

SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"[\x{621}-\x{64a}\x{660}-\x{669}\x{6f0}-\x{6f9}A-Za-z0-9_]+"
CUT = "chr(57344)"  # a character that no text here holds


def count(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{WORD}'))"


def stripped(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')"


def divide(source: str, name: str, pattern: str, most: int) -> str:
    """Spans (doc_id, para, place, text) of ``source`` cut behind each match of ``pattern`` where they have over ``most`` words.

    Neighbouring pieces go together up to the budget: from each piece the next group's first is looked up among
    cumulated counts, and groups are walked from first to first.
    """
    marked = f"regexp_replace(text, '({pattern})', '\\1' || {CUT}, 'g')"
    return f"""
      {name}_l AS (SELECT *, row_number() OVER () AS span FROM {source} WHERE {count('text')} > {most}),
      {name}_p AS (SELECT span, doc_id, para, place, unnest(list_filter(string_split({marked}, {CUT}), lambda x: x <> '')) AS piece,
        generate_subscripts(list_filter(string_split({marked}, {CUT}), lambda x: x <> ''), 1) AS i FROM {name}_l),
      {name}_c AS (SELECT *, {count('piece')} AS n, sum({count('piece')}) OVER w AS upto, sum(length(piece)) OVER w - length(piece) AS off FROM {name}_p WINDOW w AS (PARTITION BY span ORDER BY i ROWS UNBOUNDED PRECEDING)),
      {name}_n AS MATERIALIZED (SELECT a.span, a.i, CASE WHEN b.i IS NOT NULL THEN greatest(a.i + 1, b.i) END AS nxt FROM (SELECT *, upto - n + {most} AS full_at FROM {name}_c) a ASOF LEFT JOIN (SELECT span, i, upto FROM {name}_c WHERE n > 0) b ON a.span = b.span AND a.full_at < b.upto),
      {name}_g AS (SELECT span, 1::BIGINT AS i FROM {name}_l UNION ALL SELECT g.span, x.nxt FROM {name}_g g JOIN {name}_n x ON x.span = g.span AND x.i = g.i WHERE x.nxt IS NOT NULL),
      {name}_f AS (SELECT c.*, max(g.i) OVER (PARTITION BY c.span ORDER BY c.i ROWS UNBOUNDED PRECEDING) AS grp FROM {name}_c c LEFT JOIN {name}_g g ON g.span = c.span AND g.i = c.i),
      {name}_t AS (SELECT doc_id, para, span, any_value(place) + min(off) AS place, string_agg(piece, '' ORDER BY i) AS raw FROM {name}_f GROUP BY doc_id, para, span, grp),
      {name} AS (SELECT doc_id, para, place, text FROM {source} WHERE {count('text')} <= {most}
        UNION ALL SELECT doc_id, para, CAST(place + length(raw) - length(regexp_replace(raw, '^[{SPACE}]+', '')) AS BIGINT), {stripped('raw')} FROM {name}_t WHERE {stripped('raw')} <> '')"""


def units(most: int) -> str:
    """CTEs up to ``u`` (doc_id, unit_idx, start, text, paragraph_start), from the sentences ``s`` (doc_id, para, start, text)."""
    return f"""s_ AS (SELECT doc_id, para, start::BIGINT AS place, text FROM s),
      {divide('s_', 'd1', '[؛;]', most)}, {divide('d1', 'd2', '[،,:]', most)}, {divide('d2', 'd3', f'[^{SPACE}]+[{SPACE}]*', most)},
      u AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS unit_idx, place AS start, text, row_number() OVER (PARTITION BY doc_id, para ORDER BY place) = 1 AS paragraph_start FROM d3)"""


#: Checksum of a text's bytes as zip files have it, bit by bit from its polynomial.
CRC = """crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def crc(text: str) -> str:
    """Needs ``tab`` of crc_table in scope, and ``hx``, the hexadecimal digits of the text's bytes."""
    return "xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(hx) // 2), lambda k: ('0x' || substr(hx, 2 * k + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, list_extract(tab, (xor(c, b) & 255) + 1))), 4294967295)"


def vectors(normal, stem, stop: str) -> str:
    """CTEs up to ``feats`` (doc_id, unit_idx, f, tf) and ``vec`` (doc_id, unit_idx, bucket, w) from units ``u``.

    normal, stem: SQL of a text's normal form and of a word's stem.
    """
    return f"""{CRC},
      nu AS MATERIALIZED (SELECT doc_id, unit_idx, {normal('text')} AS t FROM u),
      tok AS (SELECT doc_id, unit_idx, unnest(regexp_extract_all(t, '{WORD}')) AS w FROM nu),
      kept AS (SELECT doc_id, unit_idx, w, count(*) AS c FROM tok WHERE w NOT IN ({stop}) GROUP BY ALL),
      stm AS (SELECT w, {stem('x.w')} AS st FROM (SELECT DISTINCT w FROM kept) x),
      bare AS (SELECT doc_id, unit_idx, unnest(string_split(t, ' ')) AS w FROM nu ANTI JOIN kept USING (doc_id, unit_idx) WHERE t <> ''),
      grams AS (SELECT st, 'w:' || st AS f, 2.0::DOUBLE AS wt FROM (SELECT DISTINCT st FROM stm)
        UNION ALL SELECT st, 'c:' || substr(' ' || st || ' ', p, k), 1.0 FROM (SELECT DISTINCT st FROM stm) CROSS JOIN range(2, 5) kk(k) CROSS JOIN range(1, 40) pp(p) WHERE p + k - 1 <= length(st) + 2),
      grams_ AS (SELECT st, f, sum(wt) AS wt FROM grams GROUP BY st, f),
      per_stem AS (SELECT doc_id, unit_idx, st, sum(c) AS c FROM kept JOIN stm USING (w) GROUP BY ALL),
      feats AS MATERIALIZED (SELECT doc_id, unit_idx, f, sum(wt * c)::DOUBLE AS tf FROM (SELECT doc_id, unit_idx, f, wt, c FROM per_stem JOIN grams_ USING (st) UNION ALL SELECT doc_id, unit_idx, 'w:' || w, 1.0, 1 FROM bare) GROUP BY ALL),
      place AS MATERIALIZED (SELECT f, h % 2048 AS bucket, CASE WHEN h >> 31 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sgn FROM (SELECT f, {crc('f')} AS h FROM (SELECT DISTINCT f, hex(encode(f)) AS hx FROM feats), crc_table)),
      docn AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
      df AS (SELECT doc_id, f, count(*) AS df FROM feats GROUP BY ALL),
      raw AS (SELECT doc_id, unit_idx, bucket, sum(sgn * (1 + ln(tf)) * CASE WHEN n > 1 THEN ln((1 + n)::DOUBLE / (1 + df)) + 1 ELSE 1 END) AS x FROM feats JOIN df USING (doc_id, f) JOIN docn USING (doc_id) JOIN place USING (f) GROUP BY ALL),
      vec AS MATERIALIZED (SELECT doc_id, unit_idx, bucket, x / coalesce(nullif(sqrt(sum(x * x) OVER (PARTITION BY doc_id, unit_idx)), 0), 1) AS w FROM raw WHERE abs(x) > 1e-9)"""


def distances(window: int = 3) -> str:
    """CTE ``gap`` (doc_id, unit_idx, dist): the gap behind each unit but the last, from products of units near each other."""
    near = 2 * window - 1
    return f"""near AS (SELECT a.doc_id, a.unit_idx AS a, b.unit_idx AS b, sum(a.w * b.w) AS p FROM (SELECT doc_id, unit_idx, bucket, w, unit_idx + d AS other FROM vec CROSS JOIN range(0, {near + 1}) dd(d)) a JOIN vec b ON a.doc_id = b.doc_id AND a.other = b.unit_idx AND a.bucket = b.bucket GROUP BY ALL),
      sym AS (SELECT doc_id, a, b, p FROM near UNION ALL SELECT doc_id, b, a, p FROM near WHERE a <> b),
      part AS (SELECT g.doc_id, g.unit_idx, sum(p) FILTER (a <= g.unit_idx AND b <= g.unit_idx) AS ll, sum(p) FILTER (a > g.unit_idx AND b > g.unit_idx) AS rr, sum(p) FILTER (a <= g.unit_idx AND b > g.unit_idx) AS lr
        FROM (SELECT doc_id, unit_idx, unnest(range(unit_idx - {window - 1}, unit_idx + {window + 1})) AS a FROM u) g JOIN sym USING (doc_id, a) WHERE b > g.unit_idx - {window} AND b <= g.unit_idx + {window} GROUP BY ALL),
      gap AS MATERIALIZED (SELECT u.doc_id, u.unit_idx, CASE WHEN coalesce(ll, 0) > 0 AND coalesce(rr, 0) > 0 THEN round(1 - coalesce(lr, 0) / sqrt(ll * rr), 12) + 0.0::DOUBLE ELSE 1.0 END AS dist FROM u JOIN docn USING (doc_id) LEFT JOIN part USING (doc_id, unit_idx) WHERE unit_idx < n - 1)"""


def scores(bias: str, kind: str = "percentile", amount: float = 0.7) -> str:
    """CTEs ``sc`` (doc_id, unit_idx, dist, score) and ``th`` (doc_id, theta, scale); ``bias`` is SQL of a unit's discourse sign."""
    theta = {"percentile": f"quantile_cont(score, {amount})", "std": f"avg(score) + {amount} * stddev_pop(score)", "iqr": f"quantile_cont(score, 0.75) + {amount} * (quantile_cont(score, 0.75) - quantile_cont(score, 0.25))"}[kind]
    return f"""cue AS (SELECT doc_id, unit_idx - 1 AS unit_idx, 0.25::DOUBLE * ({bias}) + CASE WHEN paragraph_start THEN 2.0 ELSE 0.0 END AS cue FROM u),
      spread AS (SELECT doc_id, coalesce(nullif(CASE WHEN count(*) > 1 THEN stddev_pop(dist) END, 0), 1) AS sd FROM gap GROUP BY doc_id),
      sc AS MATERIALIZED (SELECT doc_id, unit_idx, dist, dist + cue * sd AS score FROM gap JOIN cue USING (doc_id, unit_idx) JOIN spread USING (doc_id)),
      th AS (SELECT doc_id, {theta} AS theta, coalesce(nullif(stddev_pop(score), 0), 1) AS scale FROM sc GROUP BY doc_id)"""


def optimal(least: int, most: int) -> str:
    """CTE ``piece`` (doc_id, idx, a, b): first unit and the one after the last of each piece of the best partition.

    Documents within the budget are one piece.  Values of the best partitions of the first j units are built up for j = 1, 2, ...
    """
    short = lambda x: f"CASE WHEN {x} < {least} THEN 100.0::DOUBLE * ({least} - ({x})) / {least} ELSE 0.0 END"
    return f"""tk AS (SELECT doc_id, unit_idx, sum({count('text')}) OVER (PARTITION BY doc_id ORDER BY unit_idx)::BIGINT AS upto FROM u),
      gains AS (SELECT doc_id, list(CASE WHEN unit_idx = 0 THEN 0.0 ELSE round((score - theta) / scale, 9) END ORDER BY unit_idx) AS g, list(upto ORDER BY unit_idx) AS upto, max(upto) AS total, count(*) AS n
        FROM tk LEFT JOIN (SELECT doc_id, unit_idx + 1 AS unit_idx, score FROM sc) USING (doc_id, unit_idx) LEFT JOIN th USING (doc_id) GROUP BY doc_id),
      big AS MATERIALIZED (SELECT doc_id, g, list_prepend(0::BIGINT, upto) AS e, n FROM gains WHERE total > {most} AND n > 1),
      dp AS (SELECT doc_id, 1::BIGINT AS j, [0.0::DOUBLE, -({short('e[2] - e[1]')})] AS val, [0::BIGINT, 0] AS org FROM big
        UNION ALL SELECT doc_id, j + 1, list_append(val, o.v), list_append(org, o.i) FROM (
          SELECT dp.doc_id, j, val, org, list_max(list_transform(list_filter(range(0, j + 1), lambda i: i = j OR e[j + 2] - e[i + 1] <= {most}), lambda i: {{'v': val[i + 1] + g[i + 1] - ({short('e[j + 2] - e[i + 1]')}), 'i': i}})) AS o FROM dp JOIN big USING (doc_id) WHERE j < n)),
      ends AS MATERIALIZED (SELECT dp.doc_id, org, n FROM dp JOIN big USING (doc_id) WHERE j = n),
      back AS (SELECT doc_id, n AS b, org[n + 1] AS a FROM ends UNION ALL SELECT back.doc_id, back.a, org[back.a + 1] FROM back JOIN ends USING (doc_id) WHERE back.a > 0),
      piece AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS idx, a, b FROM (SELECT doc_id, a, b FROM back UNION ALL SELECT doc_id, 0, n FROM gains WHERE NOT (total > {most} AND n > 1)))"""


def greedy(least: int, most: int) -> str:
    """CTE ``piece`` as in ``optimal``: pieces end before the unit that does not fit, or at the first strong gap with enough words before it."""
    return f"""tk AS (SELECT doc_id, unit_idx, {count('text')} AS k, sum({count('text')}) OVER (PARTITION BY doc_id ORDER BY unit_idx)::BIGINT AS upto FROM u),
      lists AS MATERIALIZED (SELECT doc_id, list(k ORDER BY unit_idx) AS k, list(coalesce(score > theta, FALSE) ORDER BY unit_idx) AS strong, max(upto) AS total, count(*) AS n
        FROM tk LEFT JOIN (SELECT doc_id, unit_idx + 1 AS unit_idx, score FROM sc) USING (doc_id, unit_idx) LEFT JOIN th USING (doc_id) GROUP BY doc_id),
      walk AS (SELECT doc_id, 0::BIGINT AS i, k[1]::BIGINT AS held, TRUE AS opens FROM lists WHERE total > {most} AND n > 1
        UNION ALL SELECT w.doc_id, w.i + 1, CASE WHEN w.held + k[w.i + 2] > {most} OR (w.held >= {least} AND strong[w.i + 2]) THEN k[w.i + 2] ELSE w.held + k[w.i + 2] END, w.held + k[w.i + 2] > {most} OR (w.held >= {least} AND strong[w.i + 2]) FROM walk w JOIN lists USING (doc_id) WHERE w.i + 1 < n),
      piece AS MATERIALIZED (SELECT doc_id, row_number() OVER w - 1 AS idx, a, coalesce(lead(a) OVER w, n) AS b FROM (SELECT doc_id, i AS a FROM walk WHERE opens UNION ALL SELECT doc_id, 0 FROM lists WHERE NOT (total > {most} AND n > 1)) JOIN lists USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a))"""


#: Chunks of ``piece`` with their code-point range (end: after the last one).
RANGES = """ct AS MATERIALIZED (SELECT p.doc_id, p.idx, p.a, p.b, x.start::BIGINT AS start, (y.start + length(y.text))::BIGINT AS stop FROM piece p JOIN u x ON x.doc_id = p.doc_id AND x.unit_idx = p.a JOIN u y ON y.doc_id = p.doc_id AND y.unit_idx = p.b - 1)"""
#: Length of the mean vector of each piece.
COHERENCE = """coh AS (SELECT doc_id, idx, sqrt(sum(x * x)) AS len FROM (SELECT p.doc_id, p.idx, bucket, sum(w) AS x FROM piece p JOIN vec v ON v.doc_id = p.doc_id AND v.unit_idx >= p.a AND v.unit_idx < p.b GROUP BY ALL) GROUP BY ALL)"""


def children(least: int, most: int) -> str:
    """doc_id, index, parent_id, start, end of chunks inside the parents ``piece``: each parent is cut as if it were a document, by the document's scores."""
    return f"""{RANGES}, pp AS MATERIALIZED (SELECT * FROM ct), uu AS MATERIALIZED (SELECT * FROM u), ss AS MATERIALIZED (SELECT * FROM sc), tt AS MATERIALIZED (SELECT * FROM th)
      SELECT doc_id // 100000 AS doc_id, row_number() OVER (PARTITION BY doc_id // 100000 ORDER BY start) - 1 AS "index", CAST(doc_id % 100000 AS INTEGER) AS parent_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end" FROM (
        WITH RECURSIVE u AS MATERIALIZED (SELECT p.doc_id * 100000 + p.idx AS doc_id, unit_idx - p.a AS unit_idx, uu.start, uu.text FROM uu JOIN pp p ON p.doc_id = uu.doc_id AND unit_idx >= p.a AND unit_idx < p.b),
          sc AS MATERIALIZED (SELECT p.doc_id * 100000 + p.idx AS doc_id, unit_idx - p.a AS unit_idx, score FROM ss JOIN pp p ON p.doc_id = ss.doc_id AND unit_idx >= p.a AND unit_idx < p.b - 1),
          th AS (SELECT p.doc_id * 100000 + p.idx AS doc_id, theta, scale FROM tt JOIN pp p USING (doc_id)), {optimal(least, most)}, {RANGES} SELECT doc_id, start, stop FROM ct)"""


def quality(vectors_of: str, texts: str) -> str:
    """chunk_quality of the chunks ``piece`` of ``texts`` (SQL of doc_id and text); vectors_of: CTEs of vectors of units ``u``."""
    return f"""{RANGES}, {COHERENCE}, chunk AS MATERIALIZED (SELECT doc_id, idx, substr(text, start + 1, stop - start) AS text, round_even(coalesce(len, 0) / (b - a), 4) AS coherence FROM ct JOIN ({texts}) USING (doc_id) LEFT JOIN coh USING (doc_id, idx)),
      near_chunks AS (WITH u AS (SELECT doc_id, idx AS unit_idx, text FROM chunk), {vectors_of} SELECT c.doc_id, c.unit_idx, coalesce(sum(v.w * z.w), 0) AS p FROM u c JOIN docn USING (doc_id) LEFT JOIN vec v USING (doc_id, unit_idx) LEFT JOIN vec z ON z.doc_id = c.doc_id AND z.unit_idx = c.unit_idx + 1 AND z.bucket = v.bucket WHERE c.unit_idx < n - 1 GROUP BY ALL),
      alike AS (SELECT doc_id, avg(p) AS sim FROM near_chunks GROUP BY doc_id),
      sized AS (SELECT *, len(regexp_extract_all(text, '[^{SPACE}]+')) AS n FROM chunk)
      SELECT doc_id, count(*) AS chunks, round_even(avg(n), 1) AS mean_words, CAST(min(n) AS INTEGER) AS min_words, CAST(max(n) AS INTEGER) AS max_words, round_even(stddev_pop(n) / coalesce(nullif(avg(n), 0), 1), 3) AS size_cv, round_even(sum(CAST(round(coherence * 10000) AS BIGINT))::DOUBLE / count(*), 0) / 10000 AS mean_coherence, round_even(any_value(sim), 4) AS mean_adjacent_similarity
      FROM sized LEFT JOIN alike USING (doc_id) GROUP BY doc_id"""


def chunks(overlap: int = 0) -> str:
    """The chunks of ``piece``: what ``Chunker.chunk`` gives without structure, rounded; the overlap takes in units before."""
    return f"""ct AS (SELECT p.doc_id, p.idx, p.a, p.b, x.start, y.start + length(y.text) AS "end" FROM piece p JOIN u x ON x.doc_id = p.doc_id AND x.unit_idx = greatest(p.a - {overlap}, 0) JOIN u y ON y.doc_id = p.doc_id AND y.unit_idx = p.b - 1),
      coh AS (SELECT doc_id, idx, sqrt(sum(x * x)) AS len FROM (SELECT p.doc_id, p.idx, bucket, sum(w) AS x FROM piece p JOIN vec v ON v.doc_id = p.doc_id AND v.unit_idx >= p.a AND v.unit_idx < p.b GROUP BY ALL) GROUP BY ALL)
      SELECT c.doc_id, c.idx AS "index", CAST(c.start AS INTEGER) AS start, CAST(c."end" AS INTEGER) AS "end", CAST(b - greatest(a - {overlap}, 0) AS INTEGER) AS sentence_count, round(sc.score, 4) + 0.0::DOUBLE AS boundary_score, round(coalesce(len, 0) / (b - a), 4) AS coherence
      FROM ct c LEFT JOIN coh USING (doc_id, idx) LEFT JOIN sc ON sc.doc_id = c.doc_id AND sc.unit_idx = c.a - 1"""

