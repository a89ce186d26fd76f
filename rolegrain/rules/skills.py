"""Skill dictionary and requirement-line rules."""

# Skill -> patterns.
SKILLS = {
    "Python": [r"\bpython\b"],
    "Java": [r"\bjava\b"],
    "JavaScript": [r"\bjavascript\b"],
    "TypeScript": [r"\btypescript\b"],
    "Go": [r"\bgolang\b", r"\bgo\s+language\b", r"\bgo\s+programming\b"],
    "C++": [r"c\+\+"],
    "C#": [r"\bc#", r"\bc\s*sharp\b"],
    "Ruby": [r"\bruby\b"],
    "Rust": [r"\brust\b"],
    "Kotlin": [r"\bkotlin\b"],
    "Scala": [r"\bscala\b"],
    "React": [r"\breact\b", r"\breactjs\b", r"\breact\.js\b"],
    "Next.js": [r"\bnext\.?js\b", r"\bnextjs\b"],
    "Angular": [r"\bangular\b"],
    "Vue": [r"\bvue\b", r"\bvue\.js\b", r"\bvuejs\b"],
    "Node.js": [r"\bnode\.?js\b", r"\bnodejs\b"],
    "Spring Boot": [r"\bspring boot\b"],
    "FastAPI": [r"\bfastapi\b"],
    "Flask": [r"\bflask\b"],
    "Django": [r"\bdjango\b"],
    "REST APIs": [r"\brest\b", r"\brestful\b", r"\brest api", r"\brestful api"],
    "GraphQL": [r"\bgraphql\b"],
    "gRPC": [r"\bgrpc\b"],
    "SQL": [r"\bsql\b"],
    "PL/SQL": [r"\bpl/sql\b", r"\bplsql\b"],
    "Oracle": [r"\boracle\b"],
    "PostgreSQL": [r"\bpostgresql\b", r"\bpostgres\b"],
    "MySQL": [r"\bmysql\b"],
    "MongoDB": [r"\bmongodb\b"],
    "Redis": [r"\bredis\b"],
    "DynamoDB": [r"\bdynamodb\b"],
    "Cassandra": [r"\bcassandra\b"],
    "Snowflake": [r"\bsnowflake\b"],
    "BigQuery": [r"\bbigquery\b"],
    "Qdrant": [r"\bqdrant\b"],
    "IBM MQ": [r"\bibm mq\b"],
    "WebLogic": [r"\bweblogic\b"],
    "Kafka": [r"\bkafka\b"],
    "RabbitMQ": [r"\brabbitmq\b"],
    "SQS": [r"\bamazon sqs\b", r"\baws sqs\b", r"\bsqs\b"],
    "SNS": [r"\bamazon sns\b", r"\baws sns\b", r"\bsns\b"],
    "Linux": [r"\blinux\b", r"\bred hat\b", r"\bubuntu\b"],
    "Bash/Shell": [r"\bbash\b", r"\bshell scripting\b", r"\bshell script"],
    "Docker": [r"\bdocker\b", r"\bcontainerization\b"],
    "Kubernetes": [r"\bkubernetes\b", r"\bk8s\b"],
    "AWS": [r"\baws\b", r"\bamazon web services\b"],
    "GCP": [r"\bgcp\b", r"\bgoogle cloud\b"],
    "Azure": [r"\bazure\b"],
    "CI/CD": [
        r"\bci/cd\b",
        r"\bcontinuous integration\b",
        r"\bcontinuous delivery\b",
        r"\bcontinuous deployment\b",
    ],
    "GitHub Actions": [r"\bgithub actions\b"],
    "Git": [r"\bgit\b", r"\bgithub\b"],
    "Terraform": [r"\bterraform\b"],
    "Ansible": [r"\bansible\b"],
    "Jenkins": [r"\bjenkins\b"],
    "ELK Stack": [r"\belk\b", r"\belasticsearch\b", r"\blogstash\b", r"\bkibana\b"],
    "Prometheus": [r"\bprometheus\b"],
    "Grafana": [r"\bgrafana\b"],
    "Observability": [r"\bobservability\b", r"\bmonitoring\b", r"\balerting\b"],
    "PyTorch": [r"\bpytorch\b"],
    "TensorFlow": [r"\btensorflow\b"],
    "Scikit-learn": [r"\bscikit-learn\b", r"\bsklearn\b"],
    "Pandas": [r"\bpandas\b"],
    "NumPy": [r"\bnumpy\b"],
    "Spark": [r"\bapache spark\b", r"\bspark\b"],
    "Databricks": [r"\bdatabricks\b"],
    "Airflow": [r"\bairflow\b"],
    "MLflow": [r"\bmlflow\b"],
    "MLOps": [r"\bmlops\b", r"\bml ops\b"],
    "NLP": [r"\bnlp\b", r"\bnatural language processing\b"],
    "Computer Vision": [r"\bcomputer vision\b"],
    "LLMs": [r"\bllm\b", r"\bllms\b", r"\blarge language model"],
    "RAG": [r"\brag\b", r"\bretrieval augmented generation\b"],
    "LangChain": [r"\blangchain\b"],
    "CrewAI": [r"\bcrewai\b"],
    "Hugging Face": [r"\bhugging face\b", r"\bhuggingface\b"],
    "Embeddings": [r"\bembedding\b", r"\bembeddings\b"],
    "Vector Search": [r"\bvector search\b", r"\bvector database\b", r"\bvector db\b"],
    "System Design": [r"\bsystem design\b"],
    "Distributed Systems": [r"\bdistributed system"],
    "Microservices": [r"\bmicroservice"],
    "Concurrency": [r"\bconcurrency\b", r"\bconcurrent\b"],
    "Incident Response": [r"\bincident response\b", r"\bincident management\b"],
    "Root Cause Analysis": [r"\broot cause analysis\b", r"\brca\b"],
    "Testing": [r"\bpytest\b", r"\bunit testing\b", r"\bunit tests\b", r"\bautomated testing\b"],
    "Security": [r"\bsecurity\b", r"\bcompliance\b"],
}

# Wordings in which "go" means the language.
GO_PHRASES = [
    r"\bgolang\b",
    r"\bgo\s+language\b",
    r"\bgo\s+programming\b",
    r"\bexperience\s+(?:with|in)\s+go\b",
    r"\bproficien(?:t|cy)\s+(?:with|in)\s+go\b",
    r"\bknowledge\s+of\s+go\b",
    r"\bexpertise\s+in\s+go\b",
    r"\busing\s+go\b",
    r"\bwritten\s+in\s+go\b",
    r"\bcode(?:base)?\s+(?:written\s+)?in\s+go\b",
    r"\b(?:python|java|ruby|rust|c\+\+|javascript|typescript|kotlin|scala)\s*(?:,|/|\bor\b)\s*go\b",
    r"\bgo\s*(?:,|/|\bor\b)\s*(?:python|java|ruby|rust|c\+\+|javascript|typescript|kotlin|scala)\b",
]
GO_WORD = r"\bgo\b"

# Standalone and inline section headings.
REQUIRED_HEADINGS = [
    "minimum requirements", "minimum qualifications", "basic qualifications",
    "required qualifications", "required skills", "requirements", "qualifications",
    "what you'll need", "what you’ll need", "what you will need", "what we are looking for",
    "what we're looking for", "what we’re looking for", "what we look for",
    "what you'll bring", "what you’ll bring", "what you will bring", "what you bring",
    "who you are", "you have", "you should have", "you'll have", "you’ll have",
    "skills and experience", "experience and qualifications",
]
PREFERRED_HEADINGS = [
    "preferred qualifications", "preferred skills", "preferred experience", "preferred",
    "nice to have", "nice-to-have", "nice to haves", "bonus", "bonus points",
    "bonus qualifications", "additional qualifications", "ideally",
    "what would make you stand out",
]
OTHER_HEADINGS = [
    "about", "about us", "about the company", "about the team", "about the role", "the role",
    "what you'll do", "what you’ll do", "what you will do", "responsibilities",
    "your responsibilities", "the opportunity", "what you'll work on", "what you’ll work on",
    "benefits", "compensation", "pay", "salary",
]
HEADINGS = [
    ("required", REQUIRED_HEADINGS),
    ("preferred", PREFERRED_HEADINGS),
    ("general", OTHER_HEADINGS),
]
MAX_HEADING_CHARS = 100
HEADING_MARKS = [":", "—", "–", "-"]

# Line cues.
BOILERPLATE = [
    r"\bequal opportunity employer\b",
    r"\bequal employment opportunity\b",
    r"\bminimum wage act\b",
    r"\bapplicable federal, state, and local laws\b",
    r"\bpaid sick leave\b",
    r"\bhealth, dental, and vision\b",
    r"\bretirement benefits\b",
    r"\bparental leave\b",
    r"\bcompensation and benefits\b",
    r"\bsubject to applicable plan terms\b",
    r"\breproductive or family planning\b",
    r"\blifestyle spending accounts\b",
]
PREFERRED_LINES = [
    r"^\s*preferred(?:\s+qualifications?|\s+skills?|\s+experience)?\s*(?::|—|–|-)",
    r"^\s*nice[- ]to[- ]have(?:s)?\b",
    r"^\s*bonus(?:\s+points|\s+qualifications?)?\b",
    r"^\s*ideally\b",
    r"\bwould\s+be\s+(?:a\s+)?plus\b",
    r"\bconsidered\s+(?:a\s+)?plus\b",
]
REQUIRED_LINES = [
    r"\bmust\s+have\b",
    r"\bmust\s+possess\b",
    r"\bmust\s+demonstrate\b",
    r"\bmust\s+be\s+proficient\b",
    r"^\s*required(?:\s+skills?|\s+experience|\s+knowledge|\s+qualifications?)?\s*(?::|—|–|-)",
    r"\brequired\s+experience\b",
    r"\brequired\s+skills?\b",
    r"\brequired\s+knowledge\b",
    r"\brequired\s+proficiency\b",
    r"\brequired\s+expertise\b",
    r"\b(?:experience|knowledge|proficiency|expertise)\s+(?:is|are)\s+required\b",
    r"\bat\s+least\s+(?:one|two|three|four|five|\d+)\s+of\b",
    r"\bproficient in\b",
    r"\bproficiency in\b",
    r"\bstrong proficiency\b",
    r"\bexperience\s+with\b",
    r"\bexperience\s+in\b",
    r"\bexperience\s+working\s+(?:fluently\s+)?with\b",
    r"\bhands[- ]on experience\b",
    r"\bstrong experience\b",
    r"\bstrong knowledge\b",
    r"\bstrong understanding\b",
    r"\bdemonstrated experience\b",
    r"\bdemonstrated knowledge\b",
    r"\bexpertise in\b",
    r"\byou have\b",
    r"\byou bring\b",
    r"\byou should have\b",
    r"\bwe are looking for\b",
    r"\bwe're looking for\b",
    r"\bwe’re looking for\b",
]
CONTINUATIONS = [
    r"^and\b",
    r"^or\b",
    r"^and/or\b",
    r"^as\s+well\s+as\b",
    r"^plus\b",
    r"^including\b",
    r"^such\s+as\b",
    r"^\(",
    r"^[,;/]",
]

# Fixed values: "at least N of", list and example wordings.
AT_LEAST_OF = r"\bat\s+least\s+(one|two|three|four|five|\d+)\s+of\b"
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5}
ONE_OF = r"\b(?:one\s+of|any\s+of|either)\b"
PARENTHESES = r"\(([^()]*)\)"
EXAMPLE_IN_PARENTHESES = [r"\be\.g\.\s*,?", r"\bfor example\b"]
OR_WORD = r"\bor\b"
OR_CLAUSE = r"\bor\b|\band/or\b"
AND_SPLIT = r"\s*,?\s+\band\b\s+"
EXAMPLE_MARKERS = [
    r"\b(?:such as|for example|including)\b",
    r"\b(?:frameworks?|technologies|tools?|languages?|platforms?|providers?|databases?|services?)\s+like\b",
]
PREFERRED_AFTER = r"^\s*(?:is\s+)?preferred\b"
PREFERRED_LOOKAHEAD = 50

# Abbreviations whose full stops do not end a sentence.
ABBREVIATIONS = ["e.g.", "E.g.", "i.e.", "I.e.", "U.S.", "u.s."]
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9])"
