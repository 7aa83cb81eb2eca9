"""DuckDB twins of the fixture tables (FIXTURES.md), as SQL fragments.

Each constant is a SELECT usable as a CTE body; they read only the
pre-registered input views.
"""

# embeddings with double elements.
EMB = "SELECT vec_id, embedding::DOUBLE[] AS embedding, label FROM embeddings"

# 1.5 added to dimension `label` (DuckDB list index i is 1-based).
EMB17 = ("SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x, i: "
         "x + CASE WHEN i - 1 = label THEN 1.5 ELSE 0.0 END) AS embedding, label FROM embeddings")

# F8: predicted cluster, -1 = unclustered.
PRED_EXPR = ("CASE WHEN vec_id % 17 = 0 THEN -1 WHEN vec_id % 5 = 0 THEN (label + 1) % 10 "
             "ELSE label END")


def uniform(*parts: str) -> str:
    """md5 uniform in [0, 1) of colon-joined parts (each a SQL expression)."""
    key = "concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0)"


def hash_u32(*parts: str) -> str:
    key = "concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


def acgt(id_expr: str) -> str:
    s = f"CAST({id_expr} AS VARCHAR)"
    return (f"translate(md5({s}) || md5({s} || 'b'), '0123456789abcdef', "
            f"'ACGTACGTACGTACGT')")


def r6(expr: str) -> str:
    return f"(round(({expr})::DOUBLE, 6) + 0.0)"


def dot_sql(x: str, y: str) -> str:
    return f"list_dot_product({x}, {y})"


def cos_sql(x: str, y: str) -> str:
    return (f"(list_dot_product({x}, {y}) / (greatest(sqrt(list_dot_product({x}, {x})), 1e-8) * "
            f"greatest(sqrt(list_dot_product({y}, {y})), 1e-8)))")


def sqdist_sql(x: str, y: str) -> str:
    return f"list_sum(list_transform({x}, lambda v, i: (v - {y}[i]) * (v - {y}[i])))"


def mix_sql(x: str, y: str, lam: float) -> str:
    return f"list_transform({x}, lambda v, i: {lam!r} * v + {1.0 - lam!r} * {y}[i])"


# Embeddings with their L2-normalised copy u (a zero vector stays zero).
EMB_U = ("SELECT vec_id, x, list_transform(x, lambda v: v / greatest(nrm, 1e-12)) AS u FROM "
         "(SELECT vec_id, embedding::DOUBLE[] AS x, "
         "sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS nrm FROM embeddings)")

# pairs (idx, z1, z2) of consecutive embeddings.
PAIRS = ("SELECT a.vec_id // 2 AS idx, a.embedding::DOUBLE[] AS z1, b.embedding::DOUBLE[] AS z2 "
         "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0")

# batches of 64 with z3 = z2 at (pos + 7) mod N.
BATCHES = (f"SELECT b0.batch, b0.pos, b0.z1, b0.z2, t.z2 AS z3, sz.n FROM "
           f"(SELECT idx // 64 AS batch, (idx % 64)::INTEGER AS pos, z1, z2 FROM ({PAIRS})) b0 "
           f"JOIN (SELECT idx // 64 AS batch, count(*) AS n FROM ({PAIRS}) GROUP BY 1) sz USING (batch) "
           f"JOIN (SELECT idx // 64 AS batch, (idx % 64)::INTEGER AS pos, z2 FROM ({PAIRS})) t "
           f"ON t.batch = b0.batch AND t.pos = (b0.pos + 7) % sz.n")


def tokens_sql(text: str) -> str:
    return (f"list_filter(regexp_split_to_array(coalesce({text}, ' '), '[ \\t\\n\\r\\f]+'), "
            f"lambda t: t <> '')")


def vocab_sql(tok_table: str, size: int = 4096) -> str:
    """(token, id, count) top size-5 tokens of a table with a `tokens` list column."""
    return (f"SELECT token, (row_number() OVER (ORDER BY cnt DESC, token) + 4)::INTEGER AS id, "
            f"cnt AS count FROM (SELECT token, count(*) AS cnt FROM "
            f"(SELECT unnest(tokens) AS token FROM {tok_table}) GROUP BY token "
            f"ORDER BY cnt DESC, token LIMIT {size - 5})")


def ids_sql(tok_table: str, key: str, vocab: str) -> str:
    """(key, ids) with the whole token list looked up (unknown -> 1), order kept."""
    return (f"SELECT {key}, coalesce(list(coalesce(v.id, 1) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), "
            f"[]::INTEGER[]) AS ids FROM "
            f"(SELECT {key}, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS pos "
            f"FROM {tok_table} UNION ALL SELECT {key}, NULL, NULL FROM {tok_table} WHERE len(tokens) = 0) t "
            f"LEFT JOIN {vocab} v USING (token) GROUP BY {key}")


def trunc_sql(ids: str, max_len: int = 128) -> str:
    return f"([2] || {ids}[1:{max_len - 2}] || [3])"


def pad_sql(ids: str, max_len: int = 128) -> str:
    return f"list_resize({ids}, {max_len}, 0)"


def mask_sql(ids: str, max_len: int = 128) -> str:
    return f"list_transform(range(1, {max_len + 1}), lambda i: CASE WHEN i <= len({ids}) THEN 1 ELSE 0 END)"
