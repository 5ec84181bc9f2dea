"""Schemas of stored tables; readers always name one."""

SECTIONS = "array<struct<heading:string,text:string>>"
META = "struct<pmid:string,journal:string,doi:string,publication_types:array<string>,mesh_terms:array<string>,authors:array<string>,path:string,bytes:bigint>"
DOCUMENTS = f"doc_id string, title string, source_type string, sections {SECTIONS}, url string, date string, meta {META}"
CHUNKS = f"chunk_id string, doc_id string, ordinal int, text string, token_count int, title string, source_type string, section string, url string, date string, meta {META}"
GOLDEN = "qid string, question string, question_type string, gold_chunk_ids array<string>, answer string, provenance struct<source:string,corpus_fingerprint:string>"
RANKINGS = "qid string, source string, chunk_id string, raw_score double, rank int"
RECORDS = "qid string, question string, question_type string, gold_chunk_ids array<string>, ranked_ids array<string>, context_ids array<string>, answer string, abstained boolean, error string"
GENERATION_ITEMS = (
    "qid string, question_type string, faithfulness double, answer_relevance double, context_precision double, abstained boolean, "
    "abstention_correct boolean, n_claims int, n_unsupported int, degenerate boolean, errors array<string>"
)
HUMAN_LABELS = "qid string, metric string, score double, note string"
SPANS = "trace_id string, stage string, ms double, meta map<string,string>"
