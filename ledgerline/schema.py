"""The log's columns. Payloads stay JSON text, since hashes are taken of the text; queries look into it as VARIANT."""

LOG = "project_id string, sequence_number long, event_id string, event_type string, payload string, payload_hash string, previous_hash string, ts timestamp, metadata map<string,string>"
SEGMENT = "segment string, position long, sequence_number long, ts timestamp, project_id string, event_type string, payload binary, checksum long, valid boolean"
RECEIPT = "stream_id string, velocity_seq long, wal_sequence long, event_type string, checksum long"
#: What ids and types may look like, and the largest payload in bytes.
PROJECT_PATTERN, TYPE_PATTERN, MOST_PAYLOAD = r"^[a-zA-Z0-9_-]+$", r"^[a-zA-Z0-9_.-]+$", 1 << 20
