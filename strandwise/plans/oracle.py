"""DuckDB SQL that gives the rows of the registry's queries."""

from __future__ import annotations

_DNA = "translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
_R1, _R2, _R3 = "(read_id % 20 = 7 AND p = 25)", "((read_id * 31 + p * 17) % 89 = 0)", "(read_id % 20 = 13 AND p = 20)"
_INS = "(read_id % 20 = 13 AND (read_id * 31 + 340) % 89 <> 0)"
_READS = f"""docs AS (SELECT doc_id, {_DNA} AS s FROM documents WHERE text IS NOT NULL),
reads AS (SELECT doc_id * 1000000 + i AS read_id, substr(s, i * 100 + 1, 100) AS seq
          FROM (SELECT doc_id, s, unnest(range(0, (length(s) - 1) // 100 + 1)) AS i FROM docs WHERE length(s) >= 30) WHERE length(substr(s, i * 100 + 1, 100)) >= 30)"""
_GENOME = f"genome AS (SELECT item_id AS contig, {_DNA} AS seq FROM benchmark WHERE {_DNA} <> '')"
_SIM = f"""{_GENOME}, starts AS (
    SELECT contig, s, contig * 100000 + s AS read_id, substr(seq, s + 1, 50) AS t
    FROM (SELECT contig, seq, unnest(range(0, length(seq) - 49, 3)) AS s FROM genome WHERE length(seq) >= 50)),
bases AS (SELECT read_id, p, substr(t, p + 1, 1) AS b FROM (SELECT read_id, t, unnest(range(0, 50)) AS p FROM starts)),
sim AS (SELECT read_id, string_agg(CASE WHEN {_R1} THEN '' WHEN {_R2} THEN translate(b, 'ACGT', 'CGTA') WHEN {_R3} THEN b || 'A' ELSE b END, '' ORDER BY p) AS seq FROM bases GROUP BY read_id),
planted AS (
    SELECT read_id, CAST(CASE WHEN {_R1} THEN 24 WHEN {_R2} THEN p - (CASE WHEN read_id % 20 = 7 AND p > 25 THEN 1 ELSE 0 END) + (CASE WHEN {_INS} AND p > 20 THEN 1 ELSE 0 END) ELSE 21 END AS BIGINT) AS orig_pos,
           CASE WHEN {_R1} THEN 'DEL_OF_' || b WHEN {_R2} THEN 'SUB_FROM_' || b ELSE 'INSERTION' END AS type
    FROM bases WHERE {_R1} OR {_R2} OR {_R3})"""

_STRANDED = f"""strands_of AS (SELECT contig, 0 AS strand, seq FROM genome UNION ALL SELECT contig, 1, {_RC.format('seq')} FROM genome),
placed_strands AS (SELECT contig, strand, seq, unnest(range(0, length(seq))) AS pos FROM strands_of)"""


def _kmers(name: str, source: str, k: int, key: str = "") -> str:
    keep = f"{key}, " if key else ""
    return f"{name} AS (SELECT {keep}p AS pos, substr(seq, p + 1, {k}) AS kmer FROM (SELECT *, unnest(range(0, length(seq) - {k - 1})) AS p FROM {source} WHERE length(seq) >= {k}))"


def _both(name: str, source: str) -> str:
    return f"{name} AS (SELECT kmer, CAST(count(*) AS BIGINT) AS n FROM (SELECT kmer FROM {source} UNION ALL SELECT {_RC.format('kmer')} FROM {source}) GROUP BY kmer)"


_EXPECTED = """hist AS (SELECT length(seq) AS l, count(*) AS n FROM sim GROUP BY 1), size AS (SELECT sum(length(seq)) AS g FROM genome),
expected AS (SELECT sum(n * ((l - 10) / g::DOUBLE)) AS e, sqrt(sum(n * ((l - 10) / g::DOUBLE) * (1 - (l - 10) / g::DOUBLE))) AS sd FROM hist, size WHERE l >= 11)"""
_BIN = "CAST(length(kmer) - length(translate(kmer, 'GC', '')) AS INTEGER)"
_MEDIANS = "SELECT gc_bin, round(median(ratio), 6) AS bias, CAST(count(*) AS BIGINT) AS n_ratios FROM ratios GROUP BY gc_bin"
_SIM_KMERS = f"{_kmers('rk', 'sim', 11, 'read_id')}, {_both('counts', 'rk')}"
_GENOME_KMERS = _kmers("gk", "genome", 11, "contig")
_CANDIDATE = "CASE WHEN type LIKE 'SUB%' THEN right(type, 1) || substr(kmer, 2) WHEN type = 'INSERTION' THEN substr(kmer, 2) ELSE left(kmer, 1) || right(type, 1) || substr(kmer, 2) END"
_KINDS = "kinds(type, number) AS (VALUES ('CORRECT', 0), ('INSERTION', 1), ('SUB_FROM_A', 2), ('SUB_FROM_C', 3), ('SUB_FROM_G', 4), ('SUB_FROM_T', 5), ('DEL_OF_A', 6), ('DEL_OF_C', 7), ('DEL_OF_G', 8), ('DEL_OF_T', 9), ('MULTIDEL', 10), ('NODEL', 11))"
_PLACED = "placed AS (SELECT planted.*, seq FROM planted JOIN sim USING (read_id))"
_WINDOWS = """windows AS (SELECT read_id, orig_pos, type, substr(seq, orig_pos - pos + 1, size) AS motif, CAST(pos AS INTEGER) AS pos
    FROM (SELECT *, unnest(range(0, size)) AS pos FROM (SELECT *, unnest(range(1, 7)) AS size FROM placed)) WHERE orig_pos >= pos AND orig_pos - pos + size <= length(seq))"""
_MOTIFS = "motifs AS (SELECT motif, pos, type, CAST(count(*) AS BIGINT) AS n FROM windows GROUP BY ALL)"
_STRANDS = ", ".join(f"{_kmers(f'w{k}', 'sim', k)}, {_both(f's{k}', f'w{k}')}" for k in range(1, 6)) + ", strands AS (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(1, 6)) + ")"
_PARTS = """held AS (SELECT motif AS m, pos, type, n FROM motifs WHERE length(motif) BETWEEN 2 AND 5), free AS (SELECT kmer AS m, n FROM strands WHERE length(kmer) BETWEEN 2 AND 5),
domain AS (
    SELECT a.m || right(b.m, 1) AS motif, 0 AS pos, a.type, a.n AS l, b.n AS r, (SELECT n FROM strands WHERE kmer = substr(a.m, 2)) AS i
    FROM held a JOIN free b ON substr(a.m, 2) = left(b.m, -1) WHERE a.pos = 0
    UNION ALL SELECT left(a.m, 1) || b.m, b.pos + 1, b.type, a.n, b.n, (SELECT n FROM strands WHERE kmer = substr(a.m, 2))
    FROM free a JOIN held b ON substr(a.m, 2) = left(b.m, -1) WHERE b.pos = length(b.m) - 1
    UNION ALL SELECT a.m || right(b.m, 1), a.pos, a.type, a.n, b.n, (SELECT n FROM motifs x WHERE x.motif = substr(a.m, 2) AND x.pos = a.pos - 1 AND x.type = a.type)
    FROM held a JOIN held b ON substr(a.m, 2) = left(b.m, -1) AND a.type = b.type AND b.pos = a.pos - 1 WHERE a.pos > 0 AND b.pos < length(b.m) - 1)"""
_SCORES = _PARTS + """, scored AS (SELECT d.motif, d.pos, d.type, l, r, coalesce(i, 0) AS i, coalesce(o.n, 0) AS obs FROM domain d LEFT JOIN motifs o ON o.motif = d.motif AND o.pos = d.pos AND o.type = d.type),
scores AS (SELECT motif, CAST(pos AS INTEGER) AS pos, type, CASE WHEN i <> 0 AND l * r * (i - l) * (i - r) > 0 THEN (obs - l * r / i::DOUBLE) / sqrt((l * r / i::DOUBLE) * (i - l) * (i - r) / (i * i)::DOUBLE) ELSE 0.0 END AS z FROM scored)"""
_PREDICTED = f"""{_kmers('gk', 'genome', 11)}, {_both('known', 'gk')}, {_kmers('rk', 'sim', 11, 'read_id')},
unknown AS (SELECT * FROM rk WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.kmer = rk.kmer)),
tried AS (SELECT read_id, pos, b, b || substr(kmer, 2) AS kmer FROM unknown, (VALUES ('A'), ('C'), ('G'), ('T')) v(b) WHERE b <> left(kmer, 1)),
predicted AS (SELECT read_id, CAST(pos AS BIGINT) AS orig_pos, 'SUB_FROM_' || min(b) AS type FROM tried WHERE EXISTS (SELECT 1 FROM known WHERE known.kmer = tried.kmer) GROUP BY read_id, pos HAVING count(*) = 1)"""
_CONFUSION = f"""{_KINDS}, met AS (SELECT coalesce(t.read_id, p.read_id) AS read_id, coalesce(t.orig_pos, p.orig_pos) AS orig_pos, coalesce(t.type, p.type) AS type, t.read_id IS NOT NULL AS tr, p.read_id IS NOT NULL AS sa
    FROM planted t FULL JOIN predicted p ON t.read_id = p.read_id AND t.orig_pos = p.orig_pos AND t.type = p.type),
untouched AS (SELECT read_id, i, i = length(seq) - 1 AS at_end FROM (SELECT read_id, seq, unnest(range(0, length(seq))) AS i FROM sim) e WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.read_id = e.read_id AND met.orig_pos = e.i)),
confusion AS (SELECT k.type, CAST((SELECT count(*) FROM met WHERE met.type = k.type AND tr AND sa) AS BIGINT) AS tp, CAST((SELECT count(*) FROM met WHERE met.type = k.type AND NOT tr) AS BIGINT) AS fp,
    CAST((SELECT count(*) FROM met WHERE met.type = k.type AND NOT sa) AS BIGINT) AS fn,
    CAST(CASE WHEN k.type = 'MULTIDEL' THEN 0 WHEN k.type LIKE 'DEL%' THEN (SELECT count(*) FROM untouched WHERE NOT at_end) ELSE (SELECT count(*) FROM untouched) END AS BIGINT) AS tn
    FROM kinds k WHERE number BETWEEN 1 AND 10)"""


def _linear() -> str:
    p = "((l - k) * (g - l)::DOUBLE / ((g - k + 1)::DOUBLE * (g - l + 1)))"
    return f"WITH {_SIM}, {_EXPECTED} SELECT k, round(sum(n * {p}), 6) AS e, round(sqrt(sum(n * {p} * (1 - {p}))), 6) AS sd FROM hist, size, (VALUES (11), (13), (15)) ks(k) WHERE l >= k GROUP BY k"




# Bias, filled and looked up.
_FILLED = f"""ratios AS (SELECT {_BIN} AS gc_bin, n / e AS ratio FROM (SELECT DISTINCT kmer FROM rk) JOIN counts USING (kmer), expected WHERE n >= 0.2::DOUBLE * e),
med AS (SELECT gc_bin, median(ratio) AS bias FROM ratios GROUP BY gc_bin), bins AS (SELECT CAST(i AS INTEGER) AS i, coalesce(bias, 0) AS v FROM range(0, 12) t(i) LEFT JOIN med ON gc_bin = i),
fixed AS (SELECT i, CASE i WHEN 0 THEN (SELECT arg_min(v, i) FROM bins WHERE v <> 0) WHEN 11 THEN (SELECT arg_max(v, i) FROM bins WHERE v <> 0) ELSE v END AS v FROM bins),
filled(i, b) AS (SELECT i, v FROM fixed WHERE i = 0 UNION ALL SELECT f.i, CASE WHEN f.v <> 0 THEN f.v ELSE (filled.b + coalesce(n.v, 0)) / 2 END
    FROM filled JOIN fixed f ON f.i = filled.i + 1 LEFT JOIN fixed n ON n.i = filled.i + 2)"""
_LEARNED = f"WITH RECURSIVE {_SIM}, {_EXPECTED}, {_SIM_KMERS}, {_FILLED}"

# k-mers of several sizes, and what is judged at one place of each read.
_SIZES = "sizes(k) AS (VALUES (11), (13), (15), (17), (19), (21))"


def _sized(name: str, source: str) -> str:
    cut = f"SELECT substr(seq, p + 1, k) AS kmer FROM (SELECT seq, k, unnest(range(0, length(seq) - k + 1)) AS p FROM {source}, sizes WHERE length(seq) >= k)"
    return f"{name} AS (SELECT kmer, CAST(count(*) AS BIGINT) AS n FROM (SELECT kmer FROM ({cut}) UNION ALL SELECT {_RC.format('kmer')} FROM ({cut})) GROUP BY kmer)"


_CLASSES = f"{_SIZES}, {_sized('gsized', 'genome')}, classes AS (SELECT kmer, CASE WHEN n = 1 THEN 'TRUSTED' ELSE 'REPEAT' END AS class FROM gsized)"


def _middle(name: str, instead: str, source: str = "spot", order: str = "least(a, greatest((t + 1) // 2, t - b))") -> str:
    """Windows around `instead`; a and b are the bases to the left and right of the place."""
    m = f"length({instead})"
    return f"""SELECT read_id, '{name}' AS way, t AS step, substr(seq, pos - x + 1, x) || {instead} || substr(seq, pos + 2, t - x) AS w FROM (
        SELECT *, {order} AS x FROM (SELECT *, unnest(range(1, least(a + b, least(21, length(seq)) - {m}) + 1)) AS t FROM (SELECT read_id, seq, pos, pos AS a, length(seq) - pos - 1 AS b FROM {source})))
        WHERE (t + {m}) % 2 = 1 AND t + {m} >= 11"""


def _onward(name: str, seq: str, pos: str, keys: str, source: str) -> str:
    return f"""SELECT {keys}, '{name}' AS way, i AS step, CASE WHEN i < n THEN substr(s, b + 1, 11 + 2 * i) ELSE substr(s, b - 2 * (i - n + 1) + 1, 11 + 2 * (n - 1) + 2 * (i - n + 1)) END AS w FROM (
        SELECT *, unnest(range(0, n + greatest(0, least(b // 2, (21 - 11 - 2 * (n - 1)) // 2)))) AS i FROM (
            SELECT *, (least(length(s) - b, 21) - 11) // 2 + 1 AS n FROM (SELECT *, least({pos}, length(s) - 11) AS b FROM (SELECT *, {seq} AS s FROM {source}) WHERE length(s) >= 11)))"""


_JUDGED = """judged AS (SELECT read_id, way, step, w, coalesce(class, 'UNTRUSTED') AS class FROM windows LEFT JOIN classes ON kmer = w),
decided AS (SELECT read_id, way, arg_min(class, step) FILTER (class <> 'REPEAT') AS class, arg_min(w, step) FILTER (class <> 'REPEAT') AS "window" FROM judged GROUP BY 1, 2)"""
_AT = "spot AS (SELECT read_id, seq, read_id % length(seq) AS pos FROM sim)"
_ONE_WAY = "least(a, t)"
_GROWN = f"""windows AS (
    SELECT read_id, 'left' AS way, k AS step, substr(seq, pos - k + 1, k) AS w FROM spot, sizes WHERE pos >= k
    UNION ALL SELECT read_id, 'right', k, substr(seq, pos + 2, k) FROM spot, sizes WHERE length(seq) - pos - 1 >= k
    UNION ALL {_middle('middle', "'A'")} UNION ALL {_middle('without', "''")}
    UNION ALL {_onward('onward', 'seq', 'pos', 'read_id', 'spot')}
    UNION ALL {_onward('after', "left(seq, pos) || 'A' || substr(seq, pos + 2)", 'greatest(pos - 5, 0)', 'read_id', 'spot')}
    UNION ALL {_middle('one_way', "'C'", order=_ONE_WAY)}
    UNION ALL {_middle('one_left', "''", source='(SELECT read_id, left(seq, pos + 1) AS seq, pos FROM spot)', order=_ONE_WAY)})"""
_WAYS = "ways(way) AS (VALUES ('left'), ('right'), ('middle'), ('without'), ('onward'), ('after'), ('one_way'), ('one_left'))"

# Alignments with more than one record a read.
_SEVERAL = """one AS (SELECT read_id, contig, s, seq, CASE WHEN read_id % 20 = 7 THEN '25M1D24M' WHEN read_id % 20 = 13 AND (read_id * 31 + 340) % 89 <> 0 THEN '21M1I29M' ELSE '50M' END AS cigar,
    read_id % 2 = 1 AS back, read_id % 14 = 5 AS unmapped, repeat(chr(CAST(40 + read_id % 30 AS INTEGER)), length(seq) - 1) || 'I' AS qual,
    1 + (CASE WHEN read_id % 10 = 3 THEN 1 ELSE 0 END) + (CASE WHEN read_id % 15 = 4 THEN 1 ELSE 0 END) AS records FROM sim JOIN (SELECT read_id, contig, s FROM starts) USING (read_id))"""

# What profiles say of places.
_EVERY = "every AS (SELECT read_id, seq, orig_pos, substr(seq, orig_pos + 1, 1) AS base FROM (SELECT read_id, seq, unnest(range(0, length(seq))) AS orig_pos FROM sim))"
_OVERALL = f"""{_KINDS}, bases_of AS (SELECT sum(length(seq))::BIGINT AS bases FROM sim), wrong_of AS (SELECT count(*) FILTER (type LIKE 'SUB%' OR type = 'INSERTION') AS wrong, count(*) FILTER (type LIKE 'DEL%') AS deleted FROM planted),
matrix AS (SELECT right(type, 1) AS t, substr(seq, orig_pos + 1, 1) AS base, count(*) AS n FROM planted JOIN sim USING (read_id) WHERE type LIKE 'SUB%' GROUP BY 1, 2),
rates AS (SELECT type, number, CASE type WHEN 'CORRECT' THEN bases - wrong WHEN 'NODEL' THEN bases - deleted ELSE (SELECT count(*) FROM planted p WHERE p.type = kinds.type) END AS n, bases FROM kinds, bases_of, wrong_of),
letters(base) AS (VALUES ('A'), ('C'), ('G'), ('T')),
looked AS (SELECT base, type, CASE WHEN n > 0 THEN ln(n / bases::DOUBLE) END AS log_p FROM letters, rates WHERE type NOT LIKE 'SUB%'
    UNION ALL SELECT l.base, 'SUB_FROM_' || t.base, CASE WHEN n > 0 THEN ln(n / bases::DOUBLE) END FROM letters l JOIN letters t ON l.base <> t.base CROSS JOIN bases_of LEFT JOIN matrix m ON m.base = l.base AND m.t = t.base)"""
_MOTIF_Z = f"{_PLACED}, {_WINDOWS}, {_MOTIFS}, {_STRANDS}, {_SCORES}"
_OVER = """over_windows AS (SELECT read_id, orig_pos, base, substr(seq, orig_pos - pos + 1, size) AS motif, CAST(pos AS INTEGER) AS pos
    FROM (SELECT *, unnest(range(0, size)) AS pos FROM (SELECT *, unnest(range(3, 7)) AS size FROM {0})) WHERE orig_pos >= pos AND orig_pos - pos + size <= length(seq)),
extremes AS (SELECT read_id, orig_pos, base, k.type, min(coalesce(z, 0)) AS low, max(coalesce(z, 0)) AS high FROM over_windows w CROSS JOIN (SELECT type FROM kinds WHERE number BETWEEN 1 AND 10) k
    LEFT JOIN scores s ON s.motif = w.motif AND s.pos = w.pos AND s.type = k.type GROUP BY 1, 2, 3, 4),
over AS (SELECT read_id, orig_pos, base, type, CASE WHEN abs(low) > abs(high) THEN low ELSE high END AS z FROM extremes)"""
_MOTIF_LOOKUP = f"""{_KINDS}, {_MOTIF_Z}, {_EVERY}, {_OVER.format('every')},
said AS (SELECT read_id, orig_pos, type, round(z, 5) AS score FROM over WHERE type <> 'SUB_FROM_' || base
    UNION ALL SELECT read_id, orig_pos, k.type, 0.0 FROM (SELECT DISTINCT read_id, orig_pos FROM over), (VALUES ('CORRECT'), ('NODEL')) k(type))"""
_LIKELY = """likely AS (SELECT read_id, orig_pos, arg_max(type, score * 100000000 - number) AS type FROM said JOIN kinds USING (type) GROUP BY read_id, orig_pos, number >= 6)"""


def _feature_rows(types: list[str]) -> str:
    wide = ", ".join(f"round(coalesce(max(CASE WHEN over.type = '{t}' THEN z END), 0), 5) AS \"{t}_motifZ\"" for t in types)
    return f"""WITH {_SIM}, {_KINDS}, {_MOTIF_Z}, spots AS (SELECT DISTINCT read_id, orig_pos, seq, substr(seq, orig_pos + 1, 1) AS base FROM placed), {_OVER.format('spots')}
        SELECT spots.read_id, spots.orig_pos, ascii(any_value(spots.base))::DOUBLE AS current_base, spots.orig_pos::DOUBLE AS position_in_read, length(any_value(seq))::DOUBLE AS read_length,
        (40 + spots.read_id % 30)::DOUBLE AS quality_score, {wide} FROM spots LEFT JOIN over ON over.read_id = spots.read_id AND over.orig_pos = spots.orig_pos GROUP BY spots.read_id, spots.orig_pos"""


def _kmer_scores() -> str:
    sides = {"left": ("least(a, t)", "(SELECT read_id, left(seq, pos + 1) AS seq, pos FROM spot)"), "middle": ("least(a, t)", "spot"), "right": ("0", "spot")}
    windows, columns = [], []
    for m in ("", "A", "C", "G", "T"):
        for side, (order, source) in sides.items():
            name = f"{side}_{m or 'none'}"
            # The size of a window is bounded by the whole read, whatever side it may grow to.
            rows = f"""SELECT read_id, '{name}' AS way, t AS step, substr(seq, pos - x + 1, x) || '{m}' || substr(seq, pos + 2, t - x) AS w FROM (SELECT *, {order} AS x FROM (
                SELECT *, unnest(range(1, least(a + b, least(21, length(seq)) - {len(m)}) + 1)) AS t FROM (SELECT read_id, seq, pos, {'0' if side == 'right' else 'pos'} AS a, {'0' if side == 'left' else 'length(seq) - pos - 1'} AS b FROM spot)))
                WHERE (t + {len(m)}) % 2 = 1 AND t + {len(m)} >= 11"""
            windows.append(rows)
            columns.append(f"round(coalesce(max(z) FILTER (way = '{name}'), 0), 4) AS \"{name}\"")
    return f"""WITH {_SIM}, {_CLASSES}, {_sized('rsized', 'sim')}, {_AT}, hist AS (SELECT length(seq) AS l, count(*) AS n FROM sim GROUP BY 1), size AS (SELECT sum(length(seq)) AS g FROM genome),
        pusm AS (SELECT k, sum(n * ((l - k + 1) / g::DOUBLE)) AS e, sqrt(sum(n * ((l - k + 1) / g::DOUBLE) * (1 - (l - k + 1) / g::DOUBLE))) AS sd FROM hist, size, sizes WHERE l >= k GROUP BY k),
        windows AS ({" UNION ALL ".join(windows)}), {_JUDGED}, scored AS (SELECT d.read_id, d.way, (coalesce(r.n, 0) - e) / sd AS z FROM decided d JOIN pusm ON k = length("window") LEFT JOIN rsized r ON r.kmer = "window")
        SELECT spot.read_id, spot.pos AS orig_pos, {", ".join(columns)} FROM spot LEFT JOIN scored ON scored.read_id = spot.read_id GROUP BY spot.read_id, spot.pos"""


# Correction with indels.
_TRIED = """tried AS (SELECT read_id, orig_pos, type, CASE WHEN type LIKE 'SUB%' THEN left(seq, orig_pos) || right(type, 1) || substr(seq, orig_pos + 2) WHEN type = 'INSERTION' THEN left(seq, orig_pos) || substr(seq, orig_pos + 2)
        ELSE left(seq, orig_pos + 1) || right(type, 1) || substr(seq, orig_pos + 2) END AS s
    FROM wrong, kinds WHERE number BETWEEN 1 AND 9 AND NOT (type LIKE 'SUB%' AND right(type, 1) = substr(seq, orig_pos + 1, 1)) AND (type LIKE 'SUB%' OR orig_pos < length(seq) - 1))"""
_CORRECTED = f"""{_kmers('gk', 'genome', 11)}, {_both('known', 'gk')}, {_KINDS},
wrong AS (SELECT read_id, seq, p AS orig_pos FROM (SELECT read_id, seq, unnest(range(0, length(seq))) AS p FROM sim WHERE length(seq) >= 11) e WHERE NOT EXISTS (SELECT 1 FROM known WHERE kmer = substr(seq, least(p, length(seq) - 11) + 1, 11))),
{_TRIED}, fits AS (SELECT * FROM tried WHERE length(s) >= 11 AND EXISTS (SELECT 1 FROM known WHERE kmer = substr(s, greatest(least(orig_pos, length(s) - 11), 0) + 1, 11)) AND EXISTS (SELECT 1 FROM known WHERE kmer = substr(s, greatest(least(orig_pos - 5, length(s) - 11), 0) + 1, 11)))"""
_IN_ORDER = f"""{_kmers('gk', 'genome', 11)}, {_both('known', 'gk')}, {_KINDS},
walk AS (SELECT read_id, seq, CAST(0 AS BIGINT) AS spot, CAST(-1 AS BIGINT) AS orig_pos, length(seq) AS size, '' AS type FROM sim WHERE length(seq) >= 11
    UNION ALL SELECT read_id, CASE WHEN ways <> 1 THEN seq WHEN kind LIKE 'SUB%' THEN left(seq, spot) || right(kind, 1) || substr(seq, spot + 2) WHEN kind = 'INSERTION' THEN left(seq, spot) || substr(seq, spot + 2)
            ELSE left(seq, spot + 1) || right(kind, 1) || substr(seq, spot + 2) END,
        spot + CASE WHEN ways <> 1 OR kind LIKE 'SUB%' THEN 1 WHEN kind = 'INSERTION' THEN 0 ELSE 2 END, orig_pos + 1, size, CASE WHEN ways = 1 THEN kind ELSE '' END
    FROM (SELECT read_id, seq, spot, orig_pos, size, count(*) FILTER (holds) AS ways, min(kind) FILTER (holds) AS kind
        FROM (SELECT e.*, own.kmer IS NULL AND first.kmer IS NOT NULL AND earlier.kmer IS NOT NULL AND length(s) >= 11 AND NOT (kind LIKE 'SUB%' AND right(kind, 1) = substr(seq, spot + 1, 1)) AND (kind LIKE 'SUB%' OR spot < length(seq) - 1) AS holds
            FROM (SELECT w.read_id, w.seq, w.spot, w.orig_pos, w.size, k.type AS kind, CASE WHEN k.type LIKE 'SUB%' THEN left(seq, spot) || right(k.type, 1) || substr(seq, spot + 2)
                    WHEN k.type = 'INSERTION' THEN left(seq, spot) || substr(seq, spot + 2) ELSE left(seq, spot + 1) || right(k.type, 1) || substr(seq, spot + 2) END AS s
                FROM walk w JOIN kinds k ON number BETWEEN 1 AND 9 WHERE w.orig_pos + 1 < w.size) e
            LEFT JOIN known own ON own.kmer = substr(seq, least(spot, length(seq) - 11) + 1, 11)
            LEFT JOIN known first ON first.kmer = substr(s, greatest(least(spot, length(s) - 11), 0) + 1, 11)
            LEFT JOIN known earlier ON earlier.kmer = substr(s, greatest(least(spot - 5, length(s) - 11), 0) + 1, 11))
        GROUP BY read_id, seq, spot, orig_pos, size)),
predicted AS (SELECT read_id, orig_pos, type FROM walk WHERE type <> '')"""
_HELD = f"""{_STRANDED}, held AS (SELECT w, count(*) AS c FROM (SELECT substr(seq, pos + 1, n) AS w FROM placed_strands, range(11, 52) t(n) WHERE pos + n <= length(seq)) GROUP BY w)"""
_FIRSTS = f"""{_HELD}, spots AS (SELECT read_id, seq, unnest(range(0, length(seq) - 10)) AS start FROM sim WHERE length(seq) >= 11), reached AS (SELECT *, start + 11 + 2 * ((length(seq) - start - 11) // 2) AS reach FROM spots),
rungs AS (SELECT read_id, start, t, 11 + 2 * t AS n, substr(seq, start + 1, 11 + 2 * t) AS w FROM reached, range(0, 21) r(t) WHERE start + 11 + 2 * t <= reach
    UNION ALL SELECT read_id, start, 100 + t, reach - start + 2 * t, substr(seq, start - 2 * t + 1, reach - start + 2 * t) FROM reached, range(1, 26) r(t) WHERE start - 2 * t >= 0),
judged AS (SELECT read_id, start, t, n, coalesce(c, 0) AS c FROM rungs LEFT JOIN held USING (w)),
firsts AS (SELECT read_id, start, arg_min(c, t) FILTER (c < 2) AS c, arg_min(n, t) FILTER (c < 2) AS n FROM judged GROUP BY read_id, start)"""
_GROWING = f"""{_FIRSTS}, {_KINDS}, every AS (SELECT read_id, seq, unnest(range(0, length(seq))) AS orig_pos FROM sim WHERE length(seq) >= 11),
looked AS (SELECT e.read_id, seq, orig_pos, c, n FROM every e JOIN firsts f ON f.read_id = e.read_id AND f.start = least(orig_pos, length(seq) - 11)),
stops AS (SELECT read_id, min(orig_pos) AS stop FROM looked WHERE c IS NULL GROUP BY 1),
wrong AS (SELECT read_id, seq, orig_pos, n FROM looked LEFT JOIN stops USING (read_id) WHERE c = 0 AND (stop IS NULL OR orig_pos < stop)),
{_TRIED}, sized AS (SELECT t.*, j, n + 2 * j AS m FROM tried t JOIN wrong w USING (read_id, orig_pos), range(0, 21) r(j) WHERE n + 2 * j <= length(w.seq) AND n + 2 * j <= length(s)),
fits AS (SELECT read_id, orig_pos, j, type FROM sized WHERE EXISTS (SELECT 1 FROM held WHERE w = substr(s, greatest(least(orig_pos, length(s) - m), 0) + 1, m)) AND EXISTS (SELECT 1 FROM held WHERE w = substr(s, greatest(least(orig_pos - 5, length(s) - m), 0) + 1, m))),
counted AS (SELECT read_id, orig_pos, j, count(type) AS ways, min(type) AS type FROM (SELECT read_id, orig_pos, j FROM wrong, range(0, 21) r(j) WHERE n + 2 * j <= length(seq)) LEFT JOIN fits USING (read_id, orig_pos, j) GROUP BY 1, 2, 3),
chosen AS (SELECT read_id, orig_pos, arg_min(coalesce(type, ''), j) AS type FROM counted WHERE ways <= 1 GROUP BY 1, 2)"""


def _metrics(predicted: str, confusion: str = _CONFUSION) -> str:
    """Gain and its like of `predicted` (read_id, orig_pos, type)."""
    return f"""WITH {_SIM}, {predicted}, {confusion}, summed AS (
        SELECT category, sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn, sum(tn)::DOUBLE AS tn
        FROM (SELECT CASE WHEN type = 'INSERTION' THEN 'insertions' WHEN type LIKE 'SUB%' THEN 'substitutions' ELSE 'deletions' END AS category, * FROM confusion UNION ALL SELECT 'total', * FROM confusion) GROUP BY category)
        SELECT category, round((tp - fp) / nullif(tp + fn, 0), 6) AS gain, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM summed"""


_NAIVE = "SELECT read_id, orig_pos, type FROM likely JOIN sim USING (read_id) WHERE type NOT IN ('CORRECT', 'NODEL') AND (type NOT LIKE 'DEL%' AND type <> 'MULTIDEL' OR orig_pos < length(seq) - 1)"
_MODES = {
    "fixed": f"{_CORRECTED}, predicted AS (SELECT read_id, orig_pos, min(type) AS type FROM fits GROUP BY 1, 2 HAVING count(*) = 1)",
    "growing": f"{_GROWING}, predicted AS (SELECT read_id, orig_pos, type FROM chosen WHERE type <> '')",
    "naive": f"{_MOTIF_LOOKUP}, {_LIKELY}, predicted AS ({_NAIVE})",
}
_KINDLESS = _CONFUSION.removeprefix(f"{_KINDS}, ")


SQL: dict[str, str] = {
    "kmer_count_both_strands": f"WITH {_READS}, {_kmers('k', 'reads', 11)}, {_both('counts', 'k')} SELECT kmer, n FROM counts",
    "kmer_count_forward": f"WITH {_GENOME}, {_GENOME_KMERS} SELECT kmer, CAST(count(*) AS BIGINT) AS n FROM gk GROUP BY kmer",
    "sequence_functions": f"""WITH {_READS} SELECT read_id, {_RC.format('seq')} AS rc, round((length(seq) - length(translate(seq, 'GC', ''))) / length(seq)::DOUBLE, 9) AS gc,
        CAST(length(seq) - length(translate(seq, 'GC', '')) AS INTEGER) AS gc_bin, chr(CAST((33 + (read_id * 7) % 40 + 33 + (read_id * 7 + 3) % 40) // 2 AS INTEGER)) AS mid_quality FROM reads""",
    "error_candidates": f"""WITH {_GENOME}, {_GENOME_KMERS}, {_KINDS} SELECT contig, CAST(pos AS INTEGER) AS pos, type, CAST(number AS INTEGER) AS number, {_CANDIDATE} AS before
        FROM gk, kinds WHERE number BETWEEN 1 AND 9 AND NOT (type LIKE 'SUB%' AND right(type, 1) = left(kmer, 1))""",
    "read_length_histogram": f"WITH {_READS} SELECT CAST(length(seq) AS INTEGER) AS length, CAST(count(*) AS BIGINT) AS n FROM reads GROUP BY 1",
    "expected_counts_circular": f"""WITH {_SIM}, {_EXPECTED} SELECT k, round(sum(n * ((l - k + 1) / g::DOUBLE)), 6) AS e, round(sqrt(sum(n * ((l - k + 1) / g::DOUBLE) * (1 - (l - k + 1) / g::DOUBLE))), 6) AS sd
        FROM hist, size, (VALUES (11), (13), (15)) ks(k) WHERE l >= k GROUP BY k""",
    "expected_counts_linear": _linear(),
    "bias_from_reference": f"""WITH {_SIM}, {_EXPECTED}, {_GENOME_KMERS}, {_SIM_KMERS}, ratios AS (
        SELECT {_BIN} AS gc_bin, n / (e * count(*) OVER (PARTITION BY kmer)) AS ratio FROM gk JOIN counts USING (kmer), expected) {_MEDIANS}""",
    "bias_from_reads": f"""WITH {_SIM}, {_EXPECTED}, {_SIM_KMERS}, ratios AS (
        SELECT {_BIN} AS gc_bin, n / e AS ratio FROM (SELECT DISTINCT kmer FROM rk) JOIN counts USING (kmer), expected WHERE n >= 0.2::DOUBLE * e) {_MEDIANS}""",
    "bias_from_alignment": f"""WITH {_SIM}, {_EXPECTED}, {_GENOME_KMERS},
        spans AS (SELECT contig, s AS first, s + 49 AS last FROM starts),
        seen AS (SELECT gk.contig, gk.pos, kmer, (SELECT count(*) FROM spans WHERE spans.contig = gk.contig AND first <= gk.pos AND last >= gk.pos + 10) AS obs FROM gk),
        occ AS (SELECT kmer, count(*) AS occ FROM gk GROUP BY kmer), ratios AS (SELECT {_BIN} AS gc_bin, obs / (e * occ) AS ratio FROM seen JOIN occ USING (kmer), expected WHERE obs > 0) {_MEDIANS}""",
    "kmer_classes": f"""{_LEARNED}, {_GENOME_KMERS}, {_both('known', 'gk')}
        SELECT kmer, c.n, round((c.n / b - e) / sd, 6) AS z, CASE WHEN (c.n / b - e) / sd < -2 THEN 'UNTRUSTED' WHEN (c.n / b - e) / sd > 2 THEN 'REPEAT' ELSE 'TRUSTED' END AS statistical,
        CASE WHEN c.n / b < 0.5::DOUBLE * e THEN 'UNTRUSTED' WHEN c.n / b < 1.5::DOUBLE * e THEN 'TRUSTED' ELSE 'REPEAT' END AS naive,
        CASE coalesce(known.n, 0) WHEN 0 THEN 'UNTRUSTED' WHEN 1 THEN 'TRUSTED' ELSE 'REPEAT' END AS class FROM counts c JOIN filled ON filled.i = {_BIN} LEFT JOIN known USING (kmer), expected""",
    "kmer_rule_models": f"""{_LEARNED} SELECT CAST(CASE WHEN n / b < 0.5::DOUBLE * e THEN 2 WHEN n / b > 1.5::DOUBLE * e THEN 0 ELSE 1 END AS INTEGER) AS naive,
        CAST(CASE WHEN (n / b - e) / sd < -2 THEN 2 WHEN (n / b - e) / sd > 2 THEN 0 ELSE 1 END AS INTEGER) AS statistical, CAST(count(*) AS BIGINT) AS kmers FROM counts JOIN filled ON filled.i = {_BIN}, expected GROUP BY 1, 2""",
    "true_corrections": f"WITH {_SIM} SELECT read_id, orig_pos, type FROM planted",
    "true_corrections_both_strands": f"""WITH {_SIM} SELECT read_id, CASE WHEN read_id % 2 = 0 THEN orig_pos WHEN type LIKE 'DEL%' THEN length(seq) - 2 - orig_pos ELSE length(seq) - 1 - orig_pos END AS orig_pos,
        CASE WHEN read_id % 2 = 0 OR type = 'INSERTION' THEN type ELSE left(type, -1) || translate(right(type, 1), 'ACGT', 'TGCA') END AS type FROM planted JOIN sim USING (read_id)""",
    "overall_profile": f"""WITH {_SIM}, {_KINDS}, totals AS (SELECT (SELECT sum(length(seq)) FROM sim)::BIGINT AS bases, count(*) FILTER (type LIKE 'SUB%' OR type = 'INSERTION') AS wrong, count(*) FILTER (type LIKE 'DEL%') AS deleted FROM planted),
        each AS (SELECT k.type, CAST(CASE k.type WHEN 'CORRECT' THEN bases - wrong WHEN 'NODEL' THEN bases - deleted ELSE (SELECT count(*) FROM planted p WHERE p.type = k.type) END AS BIGINT) AS n, bases FROM kinds k, totals)
        SELECT type, n, round(n / bases::DOUBLE, 9) AS rate, round(CASE WHEN n > 0 THEN ln(n / bases::DOUBLE) END, 6) AS log_p FROM each""",
    "substitution_matrix": f"WITH {_SIM} SELECT right(type, 1) AS true_base, substr(seq, orig_pos + 1, 1) AS read_base, CAST(count(*) AS BIGINT) AS n FROM planted JOIN sim USING (read_id) WHERE type LIKE 'SUB%' GROUP BY 1, 2",
    "motif_counts": f"WITH {_SIM}, {_PLACED}, {_WINDOWS}, {_MOTIFS} SELECT * FROM motifs",
    "motif_scores": f"WITH {_SIM}, {_PLACED}, {_WINDOWS}, {_MOTIFS}, {_STRANDS}, {_SCORES} SELECT motif, pos, type, round(z, 5) AS z FROM scores",
    "strongest_motif": f"""WITH {_SIM}, {_PLACED}, {_WINDOWS}, {_MOTIFS}, {_STRANDS}, {_SCORES}, ends AS (
        SELECT read_id, orig_pos, w.type, min(coalesce(z, 0)) AS low, max(coalesce(z, 0)) AS high FROM windows w LEFT JOIN scores s ON s.motif = w.motif AND s.pos = w.pos AND s.type = w.type WHERE length(w.motif) >= 3 GROUP BY 1, 2, 3)
        SELECT read_id, orig_pos, type, round(CASE WHEN abs(low) > abs(high) THEN low ELSE high END, 5) AS z FROM ends""",
    "substitution_corrections": f"WITH {_SIM}, {_PREDICTED} SELECT * FROM predicted",
    "corrected_reads": f"""WITH {_SIM}
        SELECT read_id, t AS corrected, 50 AS qualities, list_aggregate([CASE WHEN read_id % 20 = 7 AND q >= 25 THEN q - 1 WHEN {_INS} AND q > 20 THEN q + 1 ELSE q END FOR q IN range(0, 50)], 'string_agg', ' ') AS places FROM starts""",
    "confusion_counts": f"WITH {_SIM}, {_PREDICTED}, {_CONFUSION} SELECT * FROM confusion",
    "correction_metrics": _metrics(_PREDICTED),
    "correction_metrics_by_mode": " UNION ALL ".join(f"SELECT '{mode}' AS mode, * FROM ({_metrics(parts, _KINDLESS if _KINDS in parts else _CONFUSION)})" for mode, parts in _MODES.items()),
    "base_functions": f"""WITH {_SIM} SELECT read_id, 'N_' || reverse(translate(left(seq, 5), 'ACGT', 'TGCA')) AS rc, translate(substr(seq, 5, 1), 'ACGT', 'TGCA') AS base, 'N' AS gap, '@r' || read_id AS name,
        CAST(3905 + (SELECT sum((strpos('ACGT', substr(seq, i, 1)) - 1) * pow(5, 6 - i)) FROM range(1, 7) t(i)) AS BIGINT) AS motif_index, left(seq, 6) AS motif, CAST(30 + (strpos('ACGT', substr(seq, 5, 1)) - 1) * 25 + 4 AS BIGINT) AS odd_index FROM sim""",
    "minimum_sizes": f"""WITH {_GENOME}, each AS (SELECT DISTINCT CAST(length(seq) AS INTEGER) AS genome_size FROM genome), floors AS (SELECT genome_size, CAST(floor(ln(200 * genome_size) / ln(4)) AS INTEGER) AS k FROM each) SELECT genome_size, k + (k + 1) % 2 AS k FROM floors""",
    "codecs": f"""WITH {_SIM}, {_KINDS}, {_GENOME_KMERS}, {_both('known', 'gk')}, fwd AS (SELECT kmer, count(*) AS n FROM gk GROUP BY kmer),
        classed AS (SELECT CASE coalesce(fwd.n, 0) WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS number FROM known LEFT JOIN fwd USING (kmer))
        SELECT 'error' AS "of", type, CAST(count(*) AS BIGINT) AS n, CAST(any_value(number) AS INTEGER) AS number, type AS name FROM planted JOIN kinds USING (type) GROUP BY type
        UNION ALL SELECT 'kmer', list_extract(['REPEAT', 'TRUSTED', 'UNTRUSTED'], number + 1), count(*), number, list_extract(['REPEAT', 'TRUSTED', 'UNTRUSTED'], number + 1) FROM classed GROUP BY number""",
    "md_substitutions": f"WITH {_SIM} SELECT read_id, 2 AS n, 'A ' || (read_id % 20) || ',T ' || (read_id % 20 + 1 + read_id % 7 + read_id % 5) || ',' AS printed FROM sim",
    "correction_texts": f"""WITH {_SIM} SELECT read_id, orig_pos, type || ' ' || orig_pos || ' ' || substr(seq, orig_pos + 1, 1) || ' ' || CASE WHEN type = 'INSERTION' THEN '.' WHEN type LIKE 'SUB%' THEN right(type, 1) ELSE substr(seq, orig_pos + 1, 1) || right(type, 1) END || ' 1.0' AS line FROM planted JOIN sim USING (read_id)""",
    "kmer_count_sizes": f"""WITH {_SIM}, cut AS (SELECT substr(seq, p + 1, k) AS kmer FROM (SELECT seq, k, unnest(range(0, length(seq) - k + 1)) AS p FROM sim, (VALUES (10), (31), (33)) s(k) WHERE length(seq) >= k)), {_both('counts', 'cut')}
        SELECT CAST(length(kmer) AS INTEGER) AS k, n, CAST(count(*) AS BIGINT) AS kmers, min(kmer) AS first FROM counts GROUP BY 1, 2""",
    "read_length_range": f"WITH {_SIM} SELECT CAST(min(length(seq)) AS INTEGER) AS shortest, CAST(max(length(seq)) AS INTEGER) AS longest, CAST(count(*) AS BIGINT) AS reads FROM sim",
    "bias_filled": f"""{_LEARNED}, both_kinds AS (SELECT 'READS_ONLY' AS kind, i AS gc_bin, b FROM filled UNION ALL SELECT 'IGNORE', i, 1.0 FROM bins)
        SELECT kind, gc_bin, round(b, 6) AS bias, CAST(length('biases[] = ' || (gc_bin / 11.0::DOUBLE) || CAST(round(b) AS INTEGER)) AS INTEGER) AS printed FROM both_kinds""",
    "bias_lookup": f"""{_LEARNED}, {_kmers('g13', 'genome', 13)}, each AS (SELECT DISTINCT kmer, (length(kmer) - length(translate(kmer, 'GC', ''))) * 11 / 13::DOUBLE AS g FROM g13)
        SELECT kmer, round(a.b + (g - floor(g)) * (z.b - a.b), 6) AS bias FROM each JOIN filled a ON a.i = floor(g) JOIN filled z ON z.i = least(floor(g) + 1, 11)""",
    "bias_plot": f"""WITH {_SIM}, {_EXPECTED}, {_GENOME_KMERS}, {_SIM_KMERS}, spans AS (SELECT contig, s AS first, s + 49 AS last FROM starts),
        seen AS (SELECT kmer, (SELECT count(*) FROM spans WHERE spans.contig = gk.contig AND first <= gk.pos AND last >= gk.pos + 10) AS obs FROM gk), occ AS (SELECT kmer, count(*) AS occ FROM gk GROUP BY kmer),
        ratios AS (SELECT 'alignment' AS series, {_BIN} AS gc_bin, obs / (e * occ) AS ratio FROM seen JOIN occ USING (kmer), expected WHERE obs > 0
            UNION ALL SELECT 'reference', {_BIN}, n / (e * occ) FROM gk JOIN occ USING (kmer) JOIN counts USING (kmer), expected
            UNION ALL SELECT 'reads', {_BIN}, n / e FROM (SELECT DISTINCT kmer FROM rk) JOIN counts USING (kmer), expected WHERE n >= 0.2::DOUBLE * e)
        SELECT series, round(gc_bin / 11::DOUBLE, 9) AS x, round(median(ratio), 6) AS y FROM ratios GROUP BY series, gc_bin""",
    "kmer_training_rows": f"""{_LEARNED}, {_GENOME_KMERS}, {_both('known', 'gk')}, each AS (SELECT DISTINCT kmer FROM gk UNION SELECT kmer FROM counts)
        SELECT kmer, round((coalesce(c.n, 0) / b - e) / sd, 5) AS "ZScore", round((length(kmer) - length(translate(kmer, 'GC', ''))) / length(kmer)::DOUBLE, 5) AS "gcContent", 11::DOUBLE AS size, coalesce(c.n, 0)::DOUBLE AS "observedCount",
        round(coalesce(c.n, 0) / b, 5) AS "biasCorrectedObservedCount", round(e, 5) AS "expectedCountPusm", CAST(CASE coalesce(known.n, 0) WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS label
        FROM each LEFT JOIN counts c USING (kmer) LEFT JOIN known USING (kmer) JOIN filled ON filled.i = {_BIN}, expected""",
    "class_balance": f"""WITH {_SIM}, {_KINDS}, each AS (SELECT CAST(number AS INTEGER) AS label, CAST(count(*) AS BIGINT) AS n FROM planted JOIN kinds USING (type) GROUP BY 1)
        SELECT label, n, (SELECT min(n) FROM each) AS least, (SELECT max(n) FROM each) AS most, (SELECT CAST(sum(n) // count(*) AS BIGINT) FROM each) AS mean FROM each""",
    "grown_kmers": f"""WITH {_SIM}, {_CLASSES}, {_AT}, {_GROWN}, {_JUDGED}, {_WAYS} SELECT spot.read_id, ways.way, coalesce(class, 'REPEAT') AS class, "window" FROM spot CROSS JOIN ways LEFT JOIN decided d ON d.read_id = spot.read_id AND d.way = ways.way""",
    "alignment_counters": f"""WITH {_SIM}, {_SEVERAL} SELECT CAST(count(*) AS BIGINT) AS reads, CAST(count(*) FILTER (NOT unmapped) AS BIGINT) AS mapped, CAST(count(*) FILTER (records = 1) AS BIGINT) AS single FROM one""",
    "alignment_groups": f"""WITH {_SIM}, {_SEVERAL} SELECT read_id, CAST(records AS INTEGER) AS n, CASE WHEN read_id % 10 = 3 THEN '10H40M' ELSE cigar END AS first FROM one""",
    "sequenced_reads": f"""WITH {_SIM}, {_SEVERAL} SELECT '@' || read_id AS read_id, CASE WHEN back THEN {_RC.format('seq')} ELSE seq END AS seq, CASE WHEN back THEN reverse(qual) ELSE qual END AS qual, s AS begin_pos FROM one""",
    "alignment_ends": f"""WITH {_SIM}, {_SEVERAL} SELECT read_id, s AS begin_pos, s + 49 AS end_pos FROM one WHERE records = 1 AND NOT unmapped""",
    "clipped_places": f"""WITH {_SIM} SELECT read_id, CASE WHEN read_id % 2 = 1 THEN length(seq) - 1 - i ELSE i END AS orig_pos FROM sim, range(0, 4) t(i) WHERE read_id % 20 = 11""",
    "true_reads": f"WITH {_SIM} SELECT read_id, seq, t AS true_seq FROM sim JOIN (SELECT read_id, t FROM starts) USING (read_id)",
    "error_rates": f"""WITH {_SIM}, bases_of AS (SELECT sum(length(seq)) AS bases FROM sim) SELECT round(count(*) FILTER (type LIKE 'SUB%' OR type = 'INSERTION') / any_value(bases)::DOUBLE, 9) AS current_base, round(count(*) FILTER (type LIKE 'DEL%') / any_value(bases)::DOUBLE, 9) AS next_gap FROM planted, bases_of""",
    "overall_lookup": f"WITH {_SIM}, {_OVERALL}, {_EVERY} SELECT read_id, orig_pos, type, round(log_p, 6) AS score FROM every JOIN looked USING (base)",
    "approximate_counts": f"""WITH {_SIM}, {_OVERALL}, {_GENOME_KMERS}, cut AS (SELECT substr(seq, p + 1, k) AS kmer FROM (SELECT seq, k, unnest(range(0, length(seq) - k + 1)) AS p FROM sim, (VALUES (10), (11), (12)) s(k) WHERE length(seq) >= k)), {_both('counts', 'cut')},
        spots AS (SELECT kmer, p, substr(kmer, p + 1, 1) AS base FROM (SELECT DISTINCT kmer FROM gk), range(0, 11) t(p)),
        before AS (SELECT kmer, exp(log_p) AS p, CASE WHEN type LIKE 'SUB%' THEN left(kmer, p) || right(type, 1) || substr(kmer, p + 2) WHEN type = 'INSERTION' THEN left(kmer, p) || substr(kmer, p + 2) ELSE left(kmer, p + 1) || right(type, 1) || substr(kmer, p + 2) END AS b
            FROM spots JOIN looked USING (base) WHERE type NOT IN ('CORRECT', 'NODEL', 'MULTIDEL') AND log_p IS NOT NULL UNION ALL SELECT kmer, exp(sum(log_p)), kmer FROM spots JOIN looked USING (base) WHERE type IN ('CORRECT', 'NODEL') GROUP BY kmer)
        SELECT before.kmer, round(sum(before.p * coalesce(c.n, 0)), 6) AS n FROM before LEFT JOIN counts c ON c.kmer = b GROUP BY before.kmer""",
    "printed_motifs": f"WITH {_SIM}, {_MOTIF_Z} SELECT type, pos, CAST(count(*) AS BIGINT) AS n FROM scores WHERE abs(round(z, 5)) >= 1 GROUP BY 1, 2",
    "motif_lookup": f"WITH {_SIM}, {_MOTIF_LOOKUP} SELECT * FROM said",
    "likely_errors": f"WITH {_SIM}, {_MOTIF_LOOKUP}, {_LIKELY} SELECT * FROM likely WHERE type NOT IN ('CORRECT', 'NODEL')",
    "candidate_ranking": f"""WITH {_SIM}, {_OVERALL}, {_EVERY}, ranked AS (SELECT read_id, orig_pos, type, row_number() OVER (PARTITION BY read_id ORDER BY round(log_p, 6) DESC, orig_pos, number) AS rank FROM every JOIN looked USING (base) JOIN kinds USING (type) WHERE log_p IS NOT NULL AND type NOT IN ('CORRECT', 'NODEL'))
        SELECT read_id, CAST(rank AS INTEGER) AS rank, orig_pos, type FROM ranked""",
    "features_current_base": _feature_rows(["INSERTION", "SUB_FROM_A", "SUB_FROM_C", "SUB_FROM_G", "SUB_FROM_T"]),
    "features_next_gap": _feature_rows(["MULTIDEL", "DEL_OF_A", "DEL_OF_C", "DEL_OF_G", "DEL_OF_T"]),
    "kmer_score_features": _kmer_scores(),
    "training_texts": f"""WITH {_SIM}, {_KINDS} SELECT read_id, CASE WHEN number <= 5 THEN 'base' ELSE 'gap' END AS kind, ascii(substr(seq, orig_pos + 1, 1)) || ';' || orig_pos || ';' || length(seq) || ';' || number AS row FROM planted JOIN sim USING (read_id) JOIN kinds USING (type)""",
    "correct_reads": f"WITH {_SIM}, {_CORRECTED} SELECT read_id, orig_pos, min(type) AS type FROM fits GROUP BY 1, 2 HAVING count(*) = 1",
    "correct_reads_in_order": f"WITH RECURSIVE {_SIM}, {_IN_ORDER} SELECT read_id, orig_pos, type FROM predicted",
    "correction_metrics_in_order": _metrics(_IN_ORDER, _KINDLESS).replace("WITH", "WITH RECURSIVE", 1),
    "closed_gaps": f"""WITH RECURSIVE {_SIM}, {_kmers('gk', 'genome', 11)}, {_both('known', 'gk')}, gapped AS (SELECT read_id, left(t, 24) AS a, substr(t, 27 + read_id % 4) AS b FROM starts),
        walk AS (SELECT read_id, right(a, 10) AS s, left(b, 10) AS goal FROM gapped UNION ALL SELECT read_id, s || right(kmer, 1), goal FROM walk JOIN known ON left(kmer, 10) = right(s, 10) WHERE length(s) < 26),
        met AS (SELECT read_id, substr(s, 11, length(s) - 20) AS fill FROM walk WHERE length(s) >= 20 AND right(s, 10) = goal),
        shortest AS (SELECT read_id, CAST(least(count(*), 2) AS INTEGER) AS ways, min(fill) AS fill FROM met WHERE length(fill) = (SELECT min(length(m.fill)) FROM met m WHERE m.read_id = met.read_id) GROUP BY read_id),
        each AS (SELECT read_id, a, b, coalesce(ways, 0) AS ways, CASE WHEN ways = 1 THEN fill END AS fill FROM gapped LEFT JOIN shortest USING (read_id))
        SELECT read_id, CAST(24 AS BIGINT) AS orig_pos, fill, CAST(ways AS INTEGER) AS ways, a || coalesce(fill, '_') || b AS corrected FROM each""",
    "correct_reads_growing": f"WITH {_SIM}, {_GROWING} SELECT read_id, orig_pos, type FROM chosen WHERE type <> ''",
    "correct_reads_naive": f"WITH {_SIM}, {_MOTIF_LOOKUP}, {_LIKELY} {_NAIVE}",
    "corrected_texts": f"""WITH {_SIM}, texts AS (SELECT read_id, string_agg(chr(10) || type || ' ' || orig_pos || ' ' || substr(seq, orig_pos + 1, 1) || ' ' || CASE WHEN type = 'INSERTION' THEN '.' WHEN type LIKE 'SUB%' THEN right(type, 1) ELSE substr(seq, orig_pos + 1, 1) || right(type, 1) END || ' 1.0', '' ORDER BY type || ' ' || orig_pos) AS lines FROM planted JOIN sim USING (read_id) GROUP BY read_id)
        SELECT read_id, coalesce(seq || chr(10) || t || chr(10) || lines, '') AS printed FROM sim JOIN (SELECT read_id, t FROM starts) USING (read_id) LEFT JOIN texts USING (read_id)""",
    "confusion_masked": f"WITH {_SIM}, {_PREDICTED}, masked AS (SELECT read_id, i AS orig_pos FROM sim, range(0, 4) t(i) WHERE read_id % 20 = 11), {_CONFUSION.replace('NOT EXISTS (SELECT 1 FROM met', 'NOT EXISTS (SELECT 1 FROM masked WHERE masked.read_id = e.read_id AND masked.orig_pos = e.i) AND NOT EXISTS (SELECT 1 FROM met').replace('NOT tr)', 'NOT tr AND NOT EXISTS (SELECT 1 FROM masked WHERE masked.read_id = met.read_id AND masked.orig_pos = met.orig_pos))')} SELECT * FROM confusion",
    "unique_windows": f"""WITH RECURSIVE {_GENOME}, {_STRANDED}, held AS (
        SELECT contig, strand, pos, seq, CAST(1 AS BIGINT) AS n, count(*) OVER (PARTITION BY substr(seq, pos + 1, 1)) AS c FROM placed_strands
        UNION ALL SELECT contig, strand, pos, seq, n + 2, count(*) OVER (PARTITION BY substr(seq, pos + 1, n + 2)) FROM held WHERE c > 1 AND pos + n + 2 <= length(seq))
        SELECT contig, pos, min(n) FILTER (c = 1) AS n FROM held WHERE strand = 0 GROUP BY contig, pos""",
    "match_lengths": f"""WITH {_SIM}, {_STRANDED}, held AS (SELECT w, count(*) AS c FROM (SELECT substr(seq, pos + 1, n) AS w FROM placed_strands, range(1, 52) t(n) WHERE pos + n <= length(seq)) GROUP BY w),
        spots AS (SELECT read_id, seq, unnest(range(0, length(seq))) AS pos FROM sim), cut AS (SELECT read_id, pos, n, substr(seq, pos + 1, n) AS w FROM spots, range(1, 52) t(n) WHERE pos + n <= length(seq))
        SELECT read_id, cut.pos, coalesce(max(n) FILTER (c >= 1), 0) AS once, coalesce(max(n) FILTER (c >= 2), 0) AS twice FROM cut LEFT JOIN held USING (w) GROUP BY read_id, cut.pos""",
    "grown_starts": f"WITH {_SIM}, {_FIRSTS} SELECT read_id, start, CASE c WHEN 0 THEN 'UNTRUSTED' WHEN 1 THEN 'TRUSTED' ELSE 'REPEAT' END AS class, n FROM firsts",
}

_FEATURES = ("ZScore", "gcContent", "size", "observedCount", "biasCorrectedObservedCount", "expectedCountPusm")
_MODEL = f"""WITH drawn AS ({SQL['kmer_training_rows']}), split AS (SELECT *, left(md5(kmer), 1) IN ('0', '1', '2', '3', '4') AS held FROM drawn),
learned AS (SELECT label AS said, count(*) AS n, {', '.join(f'avg("{f}") AS m{i}, var_pop("{f}") AS v{i}' for i, f in enumerate(_FEATURES))} FROM split WHERE NOT held GROUP BY label),
extra AS (SELECT 1e-9 * greatest({', '.join(f'var_pop("{f}")' for f in _FEATURES)}) AS x FROM split WHERE NOT held),
scored AS (SELECT kmer, label, said, ln(n / (SELECT sum(n) FROM learned)::DOUBLE) + {' + '.join(f'(-0.5 * ln(2 * pi() * (v{i} + x)) - ("{f}" - m{i}) * ("{f}" - m{i}) / (2 * (v{i} + x)))' for i, f in enumerate(_FEATURES))} AS score FROM split, learned, extra WHERE held),
judged AS (SELECT kmer, label, said AS prediction FROM scored QUALIFY row_number() OVER (PARTITION BY kmer ORDER BY score DESC, said) = 1)"""
SQL["kmer_model_classes"] = f"{_MODEL} SELECT * FROM judged"
SQL["kmer_model_report"] = f"""{_MODEL}, names AS (SELECT label FROM judged UNION SELECT prediction FROM judged),
counted AS (SELECT n.label, count(*) FILTER (j.label = n.label AND prediction = n.label) AS hit, count(*) FILTER (prediction = n.label) AS said, count(*) FILTER (j.label = n.label) AS support FROM names n, judged j GROUP BY n.label)
SELECT label, round(CASE WHEN said > 0 THEN hit / said::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN hit / support::DOUBLE ELSE 0 END, 6) AS recall, round(2 * hit / (said + support)::DOUBLE, 6) AS f1, support FROM counted"""
