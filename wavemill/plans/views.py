"""DuckDB forms of the views in sources.tables, as WITH items."""

EVT = """evt AS (SELECT user_id AS recording, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS epoch_id,
 value / 500 AS p, (event_type = 'error')::INT AS y, event_type, event_id FROM events)"""
LI = """li AS (SELECT l_orderkey, l_linenumber, l_linestatus, (l_returnflag = 'R')::INT AS y_true, unnest(['discount', 'quantity']) AS model,
 unnest([l_discount * 10, l_quantity / 50]) AS y_prob FROM lineitem)"""
EMB = """emb AS (SELECT vec_id AS epoch_id, (label >= 5)::INT AS y, embedding::DOUBLE[] AS x FROM embeddings)"""
FEAT = """emb AS (SELECT vec_id AS epoch_id, (label >= 5)::INT AS y, embedding::DOUBLE[] AS x FROM embeddings),
feat AS (SELECT epoch_id, y, unnest(range(64))::INT AS feature, unnest(x) AS value FROM emb)"""
DOC = """doc AS (SELECT doc_id, quality AS y FROM labels WHERE quality IS NOT NULL)"""
