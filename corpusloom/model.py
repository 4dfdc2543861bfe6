"""Names, constants and schemas of the corpus model."""

from __future__ import annotations

# Sizes of chunks and windows, ranking constants and limits.
TARGET_CHARS, OVERLAP_CHARS = 3200, 480
MIN_CHUNK_CHARS, MERGED_CHARS = 400, 4000
RRF_K = 60
POOL_GLOBAL, POOL_BROAD, POOL_PROJECT = 50, 1600, 50
L2_SURE, L2_HOPELESS = 0.80, 0.95
LEAST_CONFIDENCE, COVERED, ABSENT_MEDIAN = 0.15, 0.80, 0.60
BM25_K1, BM25_B, LEAST_IDF = 1.2, 0.75, 1e-6
EXCERPT_CHARS, READ_CHARS, CANDIDATES = 600, 20_000, 10
EMBED_CHARS, EMBED_BATCH, EMBED_TRIES = 8000, 32, 3
TOOL_INPUT_CHARS, RECORD_CHARS = 200, 200_000
HALF_LIFE_DAYS, NO_DATE_DAYS = 90.0, 3650
CAPTURE_ALARM_HOURS, EXPORT_STALE_DAYS = 26.0, 35
FEED_LOG, FEED_DECISIONS, FEED_QUESTIONS, FEED_BACKLOG = 12, 12, 6, 8
WEB_DEFAULT, WEB_MOST = 20, 50

PROSE, TOOL_EVENT = "prose", "tool_event"
CURATED, REPO_DOC, TRANSCRIPT, ARCHIVE_DOC = "curated", "repo-doc", "transcript", "archive-doc"
TOOL_MEMORY, USER_MEMORY, PROJECT_BRIEF = "tool-memory", "user-memory", "project-brief"
SOURCE_TYPES = (CURATED, REPO_DOC, TRANSCRIPT, ARCHIVE_DOC, TOOL_MEMORY, USER_MEMORY, PROJECT_BRIEF)
#: Types that hold distilled knowledge already.
DISTILLED_TYPES = (CURATED, TOOL_MEMORY, USER_MEMORY, PROJECT_BRIEF)
CANONICAL, ABANDONED = "canonical", "abandoned"

# Static boosts by source type; repo documents and transcripts depend on more (see scoring.boost).
BOOSTS = {CURATED: 3.0, TOOL_MEMORY: 2.4, USER_MEMORY: 2.4, PROJECT_BRIEF: 2.0, ARCHIVE_DOC: 1.1}
BOOST_REPO_TOP, BOOST_REPO_DEEP = 2.0, 0.7
BOOST_PROSE, BOOST_TOOL_EVENT, BOOST_ABANDONED = 1.0, 0.5, 0.3

PIPELINE_VERSION, SCHEMA_VERSION = 1, 2

DOCUMENTS = "path string, source_type string, project string, root string, doc_date string, mtime double, size long, content_hash string, title string, extra string"
CHUNKS = "path string, ord int, kind string, text string, content_hash string"
