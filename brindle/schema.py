"""Row types of the engine's tables, as DDL."""

BBOX = "struct<x0:double,top:double,x1:double,bottom:double>"
DOCUMENT = "doc_id string, text string"
ELEMENT = f"doc_id string, kind string, order int, text string, heading_path array<string>, page int, bbox {BBOX}, image_ref string, image_path string, table_structured boolean, degrade array<string>"
CHUNK_COLUMNS = ("chunk_id", "doc_id", "heading_path", "text", "kind", "page", "order", "part", "idx", "bbox", "image_ref", "image_path", "table_structured", "degrade")
HIT_COLUMNS = ("query_id", "path", "chunk_id", "rank", "score")
INDEX_VERSION = 2
