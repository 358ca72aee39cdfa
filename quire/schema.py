"""Relations of the document model, as DDL."""

FORMAT_FIELDS = ("bold", "italic", "underline", "font_name", "font_size_pt", "color_rgb")
SPAN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,font_name:string,font_size_pt:double,color_rgb:string>"
CELL = f"struct<spans:array<{SPAN}>,row_span:int,col_span:int>"
BBOX = "struct<x:double,y:double,width:double,height:double>"
KINDS = ("paragraph", "heading", "table", "image")

DOCS = "doc_id string, source_path string, source_format string, metadata map<string,string>"
BLOCKS = (
    "doc_id string, idx int, kind string, text string, page_index int, has_image boolean, in_table boolean, "
    f"bbox {BBOX}, kind_confidence double, signals array<string>, spans array<{SPAN}>, align string, "
    "indent_first_line_pt double, line_spacing double, space_before_pt double, space_after_pt double, style_hint string, "
    f"docx_para_idx int, level int, level_confidence double, rows array<array<{CELL}>>, docx_table_idx int, image_format string"
)
NODES = "doc_id string, node_idx int, node_type string, tag string, html string, strings array<string>"
ARTICLES = "doc_id string, number int, title string, html string, block_indices array<int>, docx_para_indices array<int>, docx_table_indices array<int>"
