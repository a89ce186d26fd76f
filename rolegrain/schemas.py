"""Declared schemas. Nothing is inferred from data."""

OFFICE = "struct<name: string, location_values: array<string>>"
METADATA = "struct<name: string, value: array<string>>"

POSTING = (
    "board_token string, company string, posting_id string, title string, url string, content string, "
    f"location struct<name: string>, offices array<{OFFICE}>, metadata array<{METADATA}>, "
    "run_id string, fetched_at timestamp"
)

# One job of a board snapshot as it is landed; loosely typed parts stay JSON text.
BOARD_JOB = (
    "struct<id: string, title: string, absolute_url: string, content: string, company_name: string, "
    "location: struct<name: string>, offices: array<struct<name: string, location: string>>, "
    "metadata: array<struct<name: string, value: string>>>"
)
_BOARD_FIELDS = "board_token: string, company: string, run_id: string, fetched_at: timestamp, fetch_status: string"
BOARD_HEADER = f"struct<{_BOARD_FIELDS}>"
BOARD_DOCUMENT = f"struct<{_BOARD_FIELDS}, jobs: array<{BOARD_JOB}>>"

MENTION = (
    "struct<type: string, match: string, min_years: bigint, max_years: bigint, preferred: boolean, "
    "text: string, start: int, end: int>"
)
FINDING = "struct<category: string, reason: string, evidence: string>"
GROUP = "struct<section: string, skills: array<string>, min_matches: int, kind: string, text: string>"

COMPANY = "struct<name: string, board_token: string, enabled: boolean>"

FORM_FIELD = (
    "struct<index: int, tag: string, type: string, id: string, name: string, label: string, option_label: string, "
    "placeholder: string, context_text: string, required: boolean, value: string, options: array<string>>"
)
INSPECTION = (
    "requested_url string, final_url string, page_title string, form_frame_url string, "
    "fields array<struct<tag: string, type: string, name: string, id: string, label: string, placeholder: string, "
    "context_text: string, required: boolean, options: array<string>, dom_indices: array<int>, "
    "source_types: array<string>, source_count: int, decision: struct<category: string, action: string, "
    "reason: string, answer_key: string, fixed_answer: string>>>"
)

QUEUE_RESULT = (
    "struct<board_token: string, posting_id: string, company: string, title: string, queue_status: string, "
    "outcome: string, challenge_detected: boolean, ready_count: bigint, required_human_count: bigint, "
    "browser_modified: boolean, application_status_after: string, error_type: string>"
)
QUEUE_REPORT = (
    "run_id string, started_at string, completed_at string, total_seconds double, persist boolean, `limit` int, "
    "`order` string, board_token_filter string, include_in_progress boolean, submit_clicked_by_agent boolean, "
    f"application_submitted boolean, results array<{QUEUE_RESULT}>"
)
HANDOFF_ITEM = (
    "struct<label: string, category: string, required: boolean, status: string, source: string, "
    "answer_key: string, display_answer: string, reason: string>"
)
