"""Spark schemas of the model's tables (DDL strings)."""

PROPERTY = "struct<predicate:string,kind:string,value:string,lang:string,datatype:string>"
LABEL = "struct<value:string,lang:string>"
STATE = "struct<value:string,label:string,lang:string>"

RECORDS = (
    "source_seq int, ordinal bigint, cassette_id string, cassette_name string, source_path string, "
    "kind string, resource_id string, type string, substitute_target string, "
    f"modified_at timestamp, modified_at_raw string, props array<{PROPERTY}>")

TERMS = (
    f"id string, kind string, labels array<{LABEL}>, inverse_labels array<{LABEL}>, priority string, "
    f"parent string, domains array<string>, ranges array<string>, states array<{STATE}>, "
    "is_abstract boolean, is_essential boolean")

CASSETTES = "id string, name string, path string, enabled boolean, default_access string, allow_write boolean"
ROLES = "role string, project_rights array<string>, cassette_rights map<string,array<string>>"
MEMBERS = "user_id string, roles array<string>, cassette_overrides map<string,array<string>>"

DOC_FILES = (
    "cassette_id string, tree string, folder string, stem string, ext string, path string, mtime timestamp")

# one preview request file; field names are those of the JSON format
PREVIEW_JSON = (
    "requestId string, requestedAtUtc string, cassetteId string, cassetteName string, documentUri string, "
    "folderName string, documentNumber string, originalFileName string, originalLength bigint, "
    "originalSha256 string, replaced boolean, attempt int, notBeforeUtc string, lastError string")
