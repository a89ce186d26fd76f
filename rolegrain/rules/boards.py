"""Job-board addresses and state vocabulary."""

# Board addresses.
BOARD_DOMAIN = "greenhouse.io"
BOARD_HOSTS = ["job-boards.greenhouse.io", "boards.greenhouse.io"]
FORM_URL = "https://job-boards.greenhouse.io/embed/job_app?"
PATH_WORDS = ["embed", "job_board", "jobs"]

# Application life cycle.
OPEN_STATUSES = ["PENDING", "IN_PROGRESS"]
STATUSES = [
    "PENDING", "IN_PROGRESS", "APPLIED", "OA", "RECRUITER_SCREEN", "INTERVIEW",
    "TECHNICAL_INTERVIEW", "FINAL_INTERVIEW", "OFFER", "REJECTED", "WITHDRAWN",
]
INTERVIEW_STATUSES = ["RECRUITER_SCREEN", "INTERVIEW", "TECHNICAL_INTERVIEW", "FINAL_INTERVIEW"]

# Queue-run vocabulary.
QUEUE_STATUSES = ["COMPLETED", "BLOCKED", "ERROR"]
QUEUE_OUTCOMES = ["NEEDS_ASSISTANCE", "READY_NO_SUBMIT"]
QUEUE_ORDERS = ["oldest", "newest", "fit"]
ELIGIBILITY_TAG = "ELIGIBILITY:"
BROWSER_TAG = "BROWSER:"
ELIGIBILITY_QUESTION = "Please review this job's eligibility requirements before application."

# Fixed value: the board token of a scan over all boards.
ALL_BOARDS = "multi"
