"""Record types of the pipeline as Spark schemas (DDL), one source of truth."""

AXIS = "struct<score:double,pct:int,label:string,confidence:double>"
PROB = "struct<prob:double>"
SPAN = "struct<start:int,end:int>"
VERDICT = (
    f"struct<accuracy:{AXIS},usefulness:{AXIS},overreach:{PROB},commented_out:{PROB},"
    "usage:struct<input_tokens:int,cost_usd:double>,model:string>"
)

SOURCES = "file string, content binary"
RANGES = "file string, start int, end int"
FINDINGS = (
    f"id string, file string, comment {SPAN}, code {SPAN}, kind string, comment_text string, "
    "code_text string, context string, line int, column int, block string, slot string, "
    "block_text string, protected boolean, required boolean, ord bigint"
)
VERDICT_CACHE = f"salt string, id string, verdict {VERDICT}, stored timestamp"
BASELINE = "id string, rule string"
BASELINE_FILE = "version int, entries array<struct<id:string,rule:string>>"
PARSE_STATUS = "file string, ok boolean, error string"
