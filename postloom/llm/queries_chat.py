"""Query of the tool-call linking: every conversation as an exchange of calls and results."""

from __future__ import annotations

from postloom.llm.registry import query, read
from postloom.llm.tool_calls import as_tool_messages, link_tool_calls

SCHEMAS = {"reply": {
    "type": "object",
    "properties": {"prompt": {"type": "string", "minLength": 1}, "after": {"type": "array", "maxItems": 1}},
    "required": ["prompt"],
    "additionalProperties": False,
}}

SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations),
calls AS (SELECT * FROM c WHERE role = 'user'), results AS (SELECT * FROM c WHERE role = 'assistant'),
id AS (SELECT conv_id, turn, conv_id || ':' || turn AS call_id, conv_id || ':' || (turn - 2) AS ref, text FROM calls)
SELECT id.conv_id, id.turn, 0 AS idx, 'call' AS kind, id.call_id, 'reply' AS name,
       CASE WHEN r.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status, 0 AS level,
       concat_ws('; ', CASE WHEN id.turn >= 2 AND p.turn IS NULL THEN '$: unknown reference ' || id.ref END,
                 CASE WHEN id.text = '' THEN '$.prompt: too few characters' WHEN id.text IS NULL THEN '$.prompt: missing' END) AS errors,
       '{"arguments":{' || CASE WHEN id.turn >= 2 THEN '"after":[{"$ref":"' || id.ref || '"}],' ELSE '' END
         || '"prompt":' || to_json(id.text) || '},"id":"' || id.call_id || '","name":"reply"}' AS json
FROM id LEFT JOIN results r ON r.conv_id = id.conv_id AND r.turn = id.turn + 1
LEFT JOIN calls p ON p.conv_id = id.conv_id AND p.turn = id.turn - 2
UNION ALL
SELECT r.conv_id, r.turn, 0, 'result', r.conv_id || ':' || (r.turn - 1), NULL, CASE WHEN k.turn IS NULL THEN 'orphan' ELSE 'linked' END, 0, '',
       '{"content":' || to_json(r.text) || ',"tool_call_id":"' || r.conv_id || ':' || (r.turn - 1) || '"}'
FROM results r LEFT JOIN calls k ON k.conv_id = r.conv_id AND k.turn = r.turn - 1
UNION ALL
SELECT conv_id, turn, 0, 'text', NULL, NULL, 'text', 0, '', '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}'
FROM c WHERE role NOT IN ('user', 'assistant')
"""


@query("op5_tool_calls", SQL)
def op5_tool_calls(spark, sf_dir):
    return link_tool_calls(as_tool_messages(read(spark, sf_dir, "conversations"), "reply"), SCHEMAS)
