"""Schemas of the relational form."""

PROGRAM = "pid INT, name STRING, arch STRING, load_offset BIGINT, ptr_size INT"
SECTION = "pid INT, name STRING, lo BIGINT, hi BIGINT, vaddr BIGINT, x BOOLEAN, r BOOLEAN, w BOOLEAN"
FUNC = "pid INT, addr BIGINT, name STRING, in_text BOOLEAN"
EDGE = "pid INT, caller BIGINT, callee BIGINT"
CLOSURE = "pid INT, caller BIGINT, callee BIGINT, depth INT"
FEATURE = "pid INT, addr BIGINT, feat STRING"
BLOCK = "pid INT, func BIGINT, block BIGINT, is_call BOOLEAN, is_leaf BOOLEAN"
BLOCK_EDGE = "pid INT, func BIGINT, src BIGINT, dst BIGINT"
PATH = "pid INT, func BIGINT, path_no INT, pos INT, block BIGINT, boundary BOOLEAN"
PAIR_SCORE = "f0 BIGINT, f1 BIGINT, score DOUBLE, diff DOUBLE, solved BOOLEAN, status STRING"
NODE = "STRUCT<op: STRING, width: INT, args: ARRAY<INT>, value: DECIMAL(20,0), name: STRING>"
EXPR = f"expr_id BIGINT, nodes ARRAY<{NODE}>"
RANKING = "f0 BIGINT, f1 BIGINT, rank INT, score DOUBLE, diff DOUBLE"

#: The JSON of one function's flow chart.
FLOW_CHART = "func_addr BIGINT, callees MAP<STRING, STRING>, cfg ARRAY<STRUCT<start: BIGINT, `end`: BIGINT, preds: ARRAY<INT>, succs: ARRAY<INT>>>"

#: What became of a comparison; a failure is a value, not an exception.
STATUS = ("ok", "invalid", "too_hard", "timeout", "too_many_vars", "gated")
