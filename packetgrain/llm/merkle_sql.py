"""SQL of the Merkle manifest: every level as one query, siblings as lists. Eight levels below and three above the roots
of the keys: 16 million rows a key, 512 keys."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# CRC-32, reflected: the fixed value is its polynomial.
POLYNOMIAL = 3988292384


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _crc() -> list[str]:
    """Queries that end in crc(doc_id, crc)."""
    out = ["c0 AS (SELECT unnest(range(256)) AS b, b AS c)"]
    for i in range(8):
        out.append(f"c{i + 1} AS (SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END AS c FROM c{i})")
    out.append("crcs AS (SELECT list(c ORDER BY b) AS t FROM c8)")
    out.append(
        "crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(s) + 1), lambda i: "
        "CAST(ascii(s[i]) AS BIGINT))), lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1])), 4294967295) AS crc "
        "FROM (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL), crcs)"
    )
    return out


def _tree(name: str, levels: int) -> list[str]:
    """Queries of the levels above ``name0(tree, i, d)``: runs of siblings and the level they hash to."""
    out = []
    for k in range(levels):
        out.append(f"{name}_runs{k} AS (SELECT tree, i >> 3 AS i, list(d ORDER BY i) AS l, any_value(n) AS n FROM "
                   f"(SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k}) GROUP BY ALL)")
        out.append(f"{name}{k + 1} AS (SELECT tree, i, CASE WHEN n = 1 THEN l[1] ELSE sha256(array_to_string(l, '')) END AS d "
                   f"FROM {name}_runs{k})")
    return out


def _climb(name: str, levels: int, source: str, tree: str, place: str) -> list[str]:
    """Queries that lead every row of ``source`` with proof and folded up the levels."""
    out = []
    for k in range(levels):
        at = f"((s.{place} >> {3 * k}) & 7) + 1"
        out.append(
            f"{name}_up{k} AS (SELECT doc_id, leaf, tree, place, one, if(n = 1, proof, proof || lefts || rights) AS proof, "
            f"if(n = 1, folded, sha256(lefts || folded || rights)) AS folded FROM (SELECT s.*, r.n, "
            f"array_to_string(l[1:{at} - 1], '') AS lefts, array_to_string(l[{at} + 1:], '') AS rights "
            f"FROM {source} s JOIN {name}_runs{k} r ON r.tree = s.{tree} AND r.i = s.{place} >> {3 * (k + 1)}))"
        )
        source = f"{name}_up{k}"
    return out


def sql() -> str:
    low, high = 8, 3
    parts = [
        *_crc(),
        f"d AS (SELECT doc_id, lang, {_leaf('text')} AS leaf, CASE WHEN crc % 3 = 0 THEN "
        f"{_leaf(f'translate(text, {UPPER!r}, {LOWER!r})')} ELSE leaf END AS claim FROM documents LEFT JOIN crc USING (doc_id))",
        "langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM d))",
        "m AS (SELECT d.*, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place "
        "FROM d JOIN langs ON d.lang IS NOT DISTINCT FROM langs.lang)",
        "k0 AS (SELECT tree, place AS i, leaf AS d FROM m)",
        *_tree("k", low),
        f"top0 AS (SELECT 0 AS tree, tree AS i, d FROM k{low})",
        *_tree("top", high),
        "start AS (SELECT *, 0 AS one, '' AS proof, claim AS folded FROM m)",
        *_climb("k", low, "start", "tree", "place"),
        *_climb("top", high, f"k_up{low - 1}", "one", "tree"),
    ]
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, leaf, s.d AS subroot, r.d AS root, sha256(proof) AS proof_sha256, "
        f"folded AS folded_root, folded = r.d AS verified FROM top_up{high - 1} u JOIN k{low} s ON s.tree = u.tree, top{high} r"
    )
