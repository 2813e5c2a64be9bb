"""Spark schemas of the engine's tables, as DDL."""

FIELD = "struct<field:string,value:string,value_type:string>"

# One inner array per item; it is null where a listed element was not an object.
ITEMS = f"array<array<{FIELD}>>"

PAGE_FILE = "path string, modificationTime timestamp, length bigint, content binary"

HYPOTHESIS = (
    "struct<page_type:string,source:string,category:string,item_count:string,"
    "expected_fields:array<string>,confidence:string,notes:string>"
)

META = (
    "struct<timestamp:string,original_file:string,status:string,page_type:string,"
    "source:string,category:string>"
)

INSIGHTS = "struct<executive_summary:string,key_findings:string,recommendation:string>"

STATISTICS = "struct<total_items:string,key_metrics:string>"

REPORT = (
    f"struct<meta:{META},hypothesis:{HYPOTHESIS},extracted_data:string,"
    "validation:struct<hypothesis_match:boolean,expected_items:string,actual_items:string,"
    "data_quality:string,completeness:string,problem:string,notes:string>,"
    f"insights:{INSIGHTS},statistics:{STATISTICS},issue:string,"
    "partial_insights:struct<summary:string>>"
)

LEDGER_CSV = (
    "Timestamp string, Task string, Model string, Input_Tokens bigint, "
    "Output_Tokens bigint, Cost_USD string"
)
