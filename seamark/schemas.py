"""Table schemas of the corpus catalogue."""

from pyspark.sql import types as T


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


STR, INT, LONG, DBL, BOOL, TS = (T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(),
                                 T.TimestampType())
STRS = T.ArrayType(STR)
META = T.MapType(STR, STR)
VECTOR = T.ArrayType(T.FloatType())

LOCATION = _s(("start", INT), ("end", INT), ("page", INT), ("section", STR), ("start_seconds", DBL),
              ("end_seconds", DBL), ("kind", STR), ("type", STR))
STORE_FILTER = _s(("metadata", META), ("path_prefix", STR), ("media_types", STRS))
STORE_DEFINITION = _s(("parents", STRS), ("filter", STORE_FILTER), ("depth", INT))
LIMITS = _s(("storage_bytes", LONG), ("index_tokens_month", LONG), ("query_tokens_month", LONG),
            ("requests_per_minute", INT))
PLAN = _s(("name", STR), ("allow_excess", BOOL), ("limits", LIMITS), ("features", T.MapType(STR, BOOL)))

TABLES = {
    "workspaces": _s(("workspace_id", STR), ("name", STR), ("plan", PLAN)),
    "stores": _s(("workspace_id", STR), ("store_id", STR), ("name", STR), ("kind", STR),
                 ("definition", STORE_DEFINITION), ("active_revision_id", STR), ("created_at", TS), ("deleted_at", TS)),
    "index_revisions": _s(("workspace_id", STR), ("revision_id", STR), ("store_id", STR), ("profile_id", STR),
                          ("state", STR), ("created_at", TS), ("promoted_at", TS)),
    "blobs": _s(("workspace_id", STR), ("sha256", STR), ("size", LONG), ("object_key", STR), ("created_at", TS)),
    "files": _s(("workspace_id", STR), ("file_id", STR), ("path", STR), ("current_version_id", STR),
                ("metadata", META), ("created_at", TS), ("updated_at", TS), ("deleted_at", TS)),
    "file_versions": _s(("workspace_id", STR), ("version_id", STR), ("file_id", STR), ("version_no", INT),
                        ("sha256", STR), ("size", LONG), ("filename", STR), ("media_type", STR), ("created_at", TS)),
    "store_files": _s(("workspace_id", STR), ("store_id", STR), ("file_id", STR), ("pinned_version_id", STR),
                      ("added_at", TS)),
    "segments": _s(("workspace_id", STR), ("segment_id", STR), ("version_id", STR), ("profile_id", STR),
                   ("ordinal", INT), ("modality", STR), ("location", LOCATION), ("content", STR),
                   ("token_count", INT), ("embedding", VECTOR)),
    "deliveries": _s(("workspace_id", STR), ("store_id", STR), ("path", STR), ("sha256", STR), ("modified_at", TS)),
    "upload_files": _s(("workspace_id", STR), ("session_id", STR), ("file_id", STR), ("path", STR), ("size", LONG),
                       ("sha256", STR), ("media_type", STR), ("part_size", LONG)),
    "upload_parts": _s(("workspace_id", STR), ("file_id", STR), ("part_no", INT), ("size", LONG)),
    "jobs": _s(("workspace_id", STR), ("job_id", STR), ("store_id", STR), ("kind", STR), ("state", STR),
               ("created_at", TS)),
    "job_items": _s(("workspace_id", STR), ("item_id", STR), ("job_id", STR), ("path", STR), ("file_id", STR),
                    ("version_id", STR), ("state", STR), ("retryable", BOOL), ("error_code", STR),
                    ("error_message", STR), ("attempts", INT), ("updated_at", TS)),
    "usage_events": _s(("workspace_id", STR), ("kind", STR), ("quantity", LONG), ("idem_key", STR),
                       ("created_at", TS)),
    "storage_samples": _s(("workspace_id", STR), ("at", TS), ("bytes", LONG)),
    "audit_events": _s(("workspace_id", STR), ("id", LONG), ("actor", STR), ("action", STR), ("target", STR),
                       ("data", STR), ("created_at", TS)),
    "ledger": _s(("kind", STR), ("workspace_id", STR), ("id", STR), ("at", TS), ("file_ids", STRS)),
    "metrics": _s(("ts", TS), ("name", STR), ("labels", META), ("value", DBL)),
}

# One row per source that could not be prepared; failures are rows, never exceptions.
OUTCOME = _s(("version_id", STR), ("error_code", STR), ("error_message", STR), ("retryable", BOOL))
