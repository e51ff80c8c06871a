"""Settings of the engine. The values below are fixed: results depend on them."""

MAX_CHARS = 1200
MIN_CJK_RUN = 4
RRF_K = 60
STATIC_WEIGHTS = {"vector": 0.85, "fulltext": 0.05, "graph": 0.10}
REWRITE_DISCOUNT = 0.5
FULLTEXT_BOOST = 1.8
VECTOR_DAMP = 0.6
DOMINANCE_GAP = 3.0
DOMINANCE_HITS = 3
REWRITTEN = "#rw"
OCR_MIN_CHARS = 10
OCR_MIN_CONF = 0.5
VISUAL_TYPES = ("图表", "流程图", "照片")
PATHS = ("fulltext", "graph", "vector")
BM25_K1, BM25_B, BM25_FLOOR = 1.2, 0.75, 1e-6
MIN_CHUNKS_C = 3
DISCRIMINATION_GAP = 0.05
RERANK_DEPTH = 20
EMBED_BATCH = 32

#: Extensions that make a dotted token a file name.
FILE_EXTENSIONS = ("json", "yml", "yaml", "toml", "ini", "conf", "env", "md", "txt", "sh", "ps1", "py", "js", "ts", "tsx", "jsx", "go", "java", "rs", "sql", "log")

#: First entry found in a heading wins; all its occurrences are replaced by the first value.
SYNONYMS = {
    "url": ["地址", "链接"],
    "timeout": ["超时", "超时时间"],
    "requests": ["请求"],
    "参数": ["选项", "入参"],
    "配置": ["设置", "调整"],
    "模块": ["组件", "单元"],
}

#: What may have gone wrong with an element.
DEGRADE_CODES = (
    "table_unstructured", "table_row_too_long", "image_ref_unresolved", "image_fetch_failed", "image_missing", "ocr_failed", "ocr_empty",
    "ocr_low_conf", "vlm_unavailable", "vlm_failed", "vlm_bad_json", "pdf_open_failed", "pdf_page_no_text_layer", "pdf_render_failed",
    "pdf_table_bbox_missing",
)
