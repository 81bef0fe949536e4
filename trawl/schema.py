"""Schemas of the tables that operators exchange."""

from __future__ import annotations

PASSAGES = "passage_id string, text string, title string, metadata map<string,string>"
QUERIES = "query_id string, query_text string"
QRELS = "query_id string, passage_id string, grade int"
RUN = "query_id string, passage_id string, score double, rank int"
TRIPLETS = "query string, positive string, negative string"
PAIRS = "query string, passage string, label int"
EMBEDDINGS = "passage_id string, embedding array<float>"
DEAD_LETTERS = "topic string, partition int, offset long, payload string, error string, timestamp double"
EXPERIMENTS = "experiment_id string, name string, mode string, crossencoder_model string, config_json string, tags array<string>, created_at timestamp"
EXPERIMENT_RESULTS = "experiment_id string, ndcg_at_10 double, mrr_at_10 double, map double, recall_k map<string,double>, precision_k map<string,double>, latency_p50_ms double, latency_p95_ms double, latency_p99_ms double, queries_per_second double, num_queries long, num_passages long"
PER_QUERY = "experiment_id string, query_id string, ndcg double, rr double, ap double, precision double"
SIGNIFICANCE = "system_a string, system_b string, metric string, mean_a double, mean_b double, delta double, p_value double, ci_lower double, ci_upper double, effect_size double, n_queries int, is_significant boolean"
