"""SQL twins of the manifest, the hard negatives and the mix, for DuckDB."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text: eight shifts for each byte, which is added at the first."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ascii(c) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    shifted = f"list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {steps}), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))"
    return f"xor({shifted}, CAST(4294967295 AS UBIGINT))"


def _record(columns: list[str]) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns) + ")"


def _tree(name: str, levels: int) -> str:
    """CTEs {name}0.. of (grp, pos, h, n), each the level above, with the siblings of every node; {name}0's nodes are {name}."""
    parts = []
    for k in range(levels + 1):
        below = name if k == 0 else f"(SELECT grp, pos // 8 AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM {name}{k - 1} GROUP BY grp, pos // 8)"
        flank = "CASE WHEN count(*) OVER (PARTITION BY grp) > 1 THEN coalesce(string_agg(h, '') OVER (PARTITION BY grp, pos // 8 ORDER BY pos ROWS BETWEEN {}), '') ELSE '' END"
        parts.append(f"""{name}{k} AS (SELECT grp, pos, h, count(*) OVER (PARTITION BY grp) AS n, {flank.format("UNBOUNDED PRECEDING AND 1 PRECEDING")} AS lft,
            {flank.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")} AS rgt FROM {below})""")
    return ",\n".join(parts)


def _climb(name: str, start: str, tree: str, levels: int) -> str:
    """CTEs {name}1..: the fold and the proof of ``start`` (key, grp, pos, f, proof), level by level."""
    parts = []
    for k in range(levels):
        before = start if k == 0 else f"{name}{k}"
        parts.append(f"""{name}{k + 1} AS (SELECT s.key, s.grp, s.pos, CASE WHEN t.n > 1 THEN sha256(t.lft || s.f || t.rgt) ELSE s.f END AS f, s.proof || t.lft || t.rgt AS proof
            FROM {before} s JOIN {tree}{k} t ON t.grp IS NOT DISTINCT FROM s.grp AND t.pos = s.pos // {8**k})""")
    return ",\n".join(parts)


def merkle_sql(levels: int = 8, group_levels: int = 3) -> str:
    """For 8 ** levels rows of a language, 8 ** group_levels languages."""
    plain = ["doc_id", "source", "lang", "n_chars", "text"]
    low = [*plain[:4], f"translate(text, '{_UPPER}', '{_LOWER}')"]
    top, last = f"u{group_levels}", f"t{levels}"
    return f"""
        WITH d AS (SELECT doc_id, lang AS grp, {_record(plain)} AS leaf, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_record(low)} END AS altered FROM documents),
        numbered AS (SELECT *, row_number() OVER () AS key, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
        t AS (SELECT grp, pos, leaf AS h FROM numbered),
        {_tree("t", levels)},
        u AS (SELECT 0 AS grp, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, h, grp AS member FROM {last}),
        {_tree("u", group_levels)},
        a AS (SELECT key, grp, pos, coalesce(altered, leaf) AS f, '' AS proof FROM numbered),
        {_climb("a", "a", "t", levels)},
        b AS (SELECT a.key, 0 AS grp, u.pos, a.f, a.proof FROM a{levels} a JOIN u ON u.member IS NOT DISTINCT FROM a.grp),
        {_climb("b", "b", "u", group_levels)}
        SELECT n.doc_id, n.leaf, t.h AS subroot, r.h AS root, sha256(b.proof) AS proof_sha256, b.f AS folded_root, b.f = r.h AS verified
        FROM numbered n JOIN b{group_levels} b ON b.key = n.key JOIN {last} t ON t.grp IS NOT DISTINCT FROM n.grp CROSS JOIN {top} r"""


def mix_sql(turns: int = 60) -> str:
    """Targets by ``turns`` rounds of resharing; what is taken of a source is a prefix of its shuffled stream, after whole passes."""
    return rf"""
        WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(2 * sum(size) AS BIGINT) AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
        level(turn, v) AS (
            SELECT 0, 1.5::DOUBLE * sum(source_size) / sum(w) FROM s
            UNION ALL
            SELECT turn + 1, (1.5::DOUBLE * sum(source_size) - sum(CASE WHEN v * w > cap THEN cap ELSE 0 END)) / nullif(sum(CASE WHEN v * w > cap THEN 0 ELSE w END), 0)
            FROM level, s WHERE turn < {turns} GROUP BY turn, v),
        t AS (SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), (SELECT max(v) FROM level) * w), cap) AS target FROM s),
        p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
        SELECT p.doc_id, p.size, t.source_size, t.target,
               CASE WHEN t.source_size = 0 THEN 0 ELSE CAST(CAST(floor(target) AS BIGINT) // t.source_size * p.size + greatest(0, least(p.size, CAST(floor(target) AS BIGINT) % t.source_size - p.start)) AS BIGINT) END AS taken
        FROM p JOIN t ON t.source IS NOT DISTINCT FROM p.source"""


def hard_negatives_sql() -> str:
    """Every anchor against every row."""
    return """
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS rn, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (
            SELECT a.rn AS arn, a.vec_id AS anchor_id, a.label AS own, b.rn, b.vec_id, b.label, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.rn <> b.rn),
        p AS (SELECT arn, anchor_id, own, rn AS prn, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
              QUALIFY row_number() OVER (PARTITION BY arn ORDER BY score DESC, vec_id, rn) <= 5),
        n AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.arn, p.prn ORDER BY s.score DESC, s.vec_id, s.rn) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
              FROM p JOIN s ON s.arn = p.arn AND s.label <> p.own AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
