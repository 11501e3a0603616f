"""Schemas of the stored tables and of ranked results."""

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # noqa: SLF001


TABLES = {
    "content": "hash string, doc string, created_at timestamp",
    "documents": "id long, collection string, path string, title string, hash string, created_at timestamp, modified_at timestamp, active boolean, source_type string, source_uri string, "
    "summary string, llm_title string, keywords array<string>, category string, intent string, concepts array<string>, difficulty string, queries array<string>, user_metadata string, importance_score double",
    "collections": "name string, path string, pattern string, provider_type string, provider_config map<string,string>, created_at timestamp, updated_at timestamp",
    "contexts": "path string, context string, created_at timestamp",
    "chunks": "hash string, document_hash string, seq int, pos int, content string, chunk_type string, breadcrumb string, start_line int, end_line int, language string, summary string, purpose string, concepts array<string>, labels map<string,string>",
    "embeddings": "hash string, seq int, model string, embedding array<float>",
    "chunk_embeddings": "chunk_hash string, model string, embedding array<float>",
    "model_metadata": "model string, dimensions int, last_used_at timestamp",
    "llm_cache": "key string, value string, model string, created_at timestamp",
    "concepts": "id long, term string, normalized string, chunk_count long",
    "concept_chunks": "concept_id long, chunk_hash string, document_hash string, snippet string",
    "document_links": "source_id long, target_id long, link_type string",
    "directories": "path string, collection string, depth int, file_count long, child_dir_count long, dominant_language string, dominant_category string, concepts array<string>",
    "sessions": "id string, created_at timestamp, last_active_at timestamp, ttl_seconds long, context map<string,string>",
    "session_queries": "session_id string, query string, result_count long, top_results array<string>, created_at timestamp",
    "session_seen": "session_id string, document_hash string, chunk_hash string, detail string, seen_at timestamp",
    "memories": "id string, category string, content string, content_hash string, confidence double, source string, access_count long, created_at timestamp, updated_at timestamp, last_accessed_at timestamp",
}

#: Every search step maps rows of this shape to rows of this shape; ``ord`` is the rank, from 0.
RESULT_SCHEMA = (
    "id long, hash string, collection string, path string, filepath string, title string, score double, source string, category string, difficulty string, "
    "keywords array<string>, summary string, modified_at timestamp, importance double, is_chunk boolean, chunk_hash string, body string, ord long"
)


def schema(table: str) -> T.StructType:
    return _struct(TABLES[table])
