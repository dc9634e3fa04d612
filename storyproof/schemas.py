"""Column types of the tables that are read or written; nothing is inferred."""

TRAIN = "id long, book_name string, char string, caption string, content string, label string"
TEST = "id long, book_name string, char string, caption string, content string"
NOVEL = "book_name string, file_name string, file_path string, byte_len long, sha256 string, encoding string, text string, ingest_ts timestamp"
CHUNK = "book_name string, chunk_id string, chunk_text string, chunk_pos double, chapter_id string, chapter_title string, word_start long, word_end long, char_start long, char_end long, chunk_word_count long, time_bucket string, entities array<string>, entity_mentions array<string>, token_count long, run_id string"
CLAIM = "id long, book_name string, raw_book_name string, char string, caption string, char_aliases array<string>, claim_id string, raw_claim_text string, claim_text string, predicate_form array<string>, keywords array<string>, claim_type string, t_hint string, polarity string, split string, run_id string, row long"
CANDIDATE = "id long, claim_id string, book_name string, chunk_id string, chapter_id string, chunk_pos double, time_bucket string, retrieval_stage string, score_vec double, score_lex double, score_rerank double, score_lex_norm double, rank int, is_disjoint boolean, run_id string"
EVIDENCE = "id long, claim_id string, book_name string, chunk_id string, evidence_text string, label string, confidence double, verifier_model string, run_id string"
FACT = "id long, claim_id string, book_name string, chunk_id string, s string, p string, o string, o_type string, polarity string, fact_confidence double, excerpt string, span_start int, span_end int, label string, confidence double, run_id string"
VIOLATION = "struct<rule:string,supporting_triples:array<string>,confidence:double,severity:string>"
CONSTRAINT = f"id long, status string, violations array<{VIOLATION}>, supporting_triples array<string>, confidence double, solver string, run_id string"
DECISION = "id long, split string, prediction int, evidence_score double, support_weight double, contradict_weight double, neutral_weight double, support_n long, contradict_n long, neutral_n long, status string, hard_violations int, soft_violations int, logic_conf double, rationale string"
