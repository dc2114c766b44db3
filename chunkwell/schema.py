"""Column lists of the tables that operators exchange."""

CHUNK = (
    "repo_name string, file_path string, start_line int, end_line int, chunk_type string, language string, "
    "name string, parent_name string, section string, content string, seq int"
)
CHUNK_COLUMNS = [x.split()[0] for x in CHUNK.split(", ")]
FILE_KEY = ["repo_name", "file_path"]
TURN = "conversation_id string, turn int, query string, response string"
SESSION = "conversation_id string, at int"
