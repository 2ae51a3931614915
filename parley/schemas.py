"""Schemas of sessions and streams, allowed values and limits."""

from __future__ import annotations

SEGMENT = "struct<source:string,utterance:string,speaker_id:string,speaker_label:string>"
FEEDBACK = "struct<verdict:string,rated_at:string,surface:string,publish_pending:boolean>"
INSIGHT = f"struct<offset_ms:bigint,severity:string,message:string,segment_index:bigint,id:string,producer:string,feedback:{FEEDBACK},feedback_withdraw_pending:boolean>"
BLOCK = "struct<start_index:bigint,end_index:bigint,summary:string,created_at_ms:bigint>"
CHAT = "struct<id:string,role:string,content:string,status:string,parent_message_id:string,error_code:string,error_message:string,created_at:string>"
LABEL = "struct<value:string,decided_at:string,provenance:string,source:string,publish_pending:boolean>"
OUTCOME = f"struct<felt:{LABEL},converted:{LABEL}>"
SESSION = (
    "session_id string, relay_session_id string, backend_session_id string, started_at string, ended_at string, title string, title_is_auto boolean, "
    f"segments array<{SEGMENT}>, insights array<{INSIGHT}>, blocks array<{BLOCK}>, notes_markdown string, notes_status string, notes_error string, "
    f"notes_root_message_id string, notes_pending_root_message_id string, chat array<{CHAT}>, attendees array<string>, calendar_event_id string, playbook string, outcome {OUTCOME}"
)
REPLY_EVENT = "task_id string, session_id string, user_message_id string, status string, message_id string, reply_text string, error_code string, error_message string, model string, chunk string"
FILE_STAT = "session_id string, len bigint, modified_ms bigint"
VOICEPRINT = "speaker_id string, label string, centroid array<float>, sample_count bigint"

# What the fields may hold.
SOURCES = ("you", "others")
VERDICTS = ("helpful", "not_helpful", "dismissed")
PRODUCERS = ("on_device", "assistant", "signals")
SURFACES = ("live", "library")
FELT = ("good", "neutral", "bad")
CONVERTED = ("won", "lost", "open")
PROVENANCES = ("user", "assistant", "crm")
NOTES_STATUSES = ("pending", "completed", "errored", "cancelled")
REPLY_STATUSES = ("completed", "errored", "silent", "typing", "tool_call", "message", "stream")
TERMINAL_STATUSES = ("completed", "errored", "silent")
INDEX_VERSION = 1
