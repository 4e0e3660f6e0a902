"""Schemas of the store's tables and the closed sets of wire names."""

from __future__ import annotations

from pyspark.sql import types as T

#: Wire names.
RECORD_TYPES = ("file_summary", "class_summary", "method_summary", "search_term_match", "test_reference", "configuration_reference")
SYMBOL_KINDS = ("None", "File", "Class", "Interface", "Record", "Enum", "Struct", "Method", "Property", "Field")
MATCH_KINDS = ("identifier", "string_literal", "comment", "xml_doc")
EMBEDDING_STATES = ("pending", "embedded", "failed")
SCAN_STATES = ("running", "completed", "failed")


def _struct(spec: str) -> T.StructType:
    """Fields as `name type`, with ! where null is not allowed."""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "vector": T.ArrayType(T.FloatType())}
    fields = []
    for item in spec.split(","):
        name, kind = item.split()
        fields.append(T.StructField(name.rstrip("!"), kinds[kind], not name.endswith("!")))
    return T.StructType(fields)


CODE_RECORD = _struct(
    "id! string, repository_id! string, scan_job_id! string, repository_name! string, branch! string, commit_sha! string, file_path! string, line_start! int, line_end! int, record_type! string,"
    "symbol_name string, symbol_kind string, namespace string, class_name string, method_name string, summary! string, code_snippet! string, metadata_json! string, is_test_code! boolean,"
    "is_generated_code! boolean, is_stale! boolean, embedding_status! string, created_at! timestamp, updated_at! timestamp"
)
CODE_EMBEDDING = _struct(
    "id! string, code_record_id! string, embedding_model! string, embedding_model_version! string, embedding_dimension! int, embedding_vector! vector, embedding_text! string, created_at! timestamp"
)
REPOSITORY = _struct("id! string, name! string, url string, local_path string, branch! string, commit_sha! string, last_scanned_at timestamp, created_at! timestamp, updated_at! timestamp")
SCAN_JOB = _struct(
    "id! string, repository_id! string, branch! string, commit_sha! string, status! string, started_at! timestamp, completed_at timestamp, error_message string, records_created! int, records_failed! int"
)
MIGRATION = _struct("name! string, applied_at! timestamp")

#: Columns that name a record; a null symbol_name equals nothing.
RECORD_KEY = ("repository_id", "file_path", "symbol_name", "record_type", "line_start", "commit_sha")
TABLES = {"code_record": CODE_RECORD, "code_embedding": CODE_EMBEDDING, "repository": REPOSITORY, "scan_job": SCAN_JOB, "_migrations": MIGRATION}
MIGRATIONS = ("001_tables", "002_keys")
EXTRACTED = "ordinal int, record_type string, symbol_name string, symbol_kind string, namespace string, class_name string, method_name string, line_start int, line_end int, summary string, code_snippet string, metadata_json string"
