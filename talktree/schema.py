"""Column types of the archive's tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: Version of the tables' layout; written beside each snapshot and checked on reading.
SCHEMA_VERSION = 1
#: A conversation with more nodes is rejected on import; so per-conversation work is bounded.
MAX_NODES = 5_000
MAX_ID_CHARS = 512


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "l": T.LongType(), "i": T.IntegerType(), "b": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


CONVERSATIONS = _struct(
    "conversation_id:s exported_id:s title:s create_time:d update_time:d current_node:s source_file:s source_array_index:l "
    "aggregate_hash:s last_import_run_id:l is_archived:i is_starred:i default_model_slug:s metadata_json:s"
)
NODES = _struct(
    "conversation_id:s node_id:s parent_node_id:s children_json:s message_id:s role:s author_name:s create_time:d update_time:d "
    "content_type:s content_text:s content_hash:s metadata_json:s is_on_current_path:i raw_message_json:s last_import_run_id:l display_revision:s"
)
IMPORT_RUNS = _struct("id:l input_path:s input_kind:s input_sha256:s input_size:l started_at:s finished_at:s status:s summary_json:s")
SOURCE_FILES = _struct("import_run_id:l source_path:s file_type:s size:l sha256:s is_conversation_json:b is_selected_conversation_source:b")
FILE_INDEX = _struct("import_run_id:l source_path:s file_type:s extension:s size:l sha256:s related_conversation_id:s related_message_id:s")
WARNINGS = _struct("import_run_id:l source_file:s array_index:l warning_type:s keys_json:s raw_json:s created_at:s")
EXPORTS = _struct("conversation_id:s format:s output_path:s output_hash:s exported_at:s export_options_json:s")

TABLES = {
    "conversations": CONVERSATIONS,
    "nodes": NODES,
    "import_runs": IMPORT_RUNS,
    "source_files": SOURCE_FILES,
    "file_index": FILE_INDEX,
    "import_warnings": WARNINGS,
    "exports": EXPORTS,
}
