"""Small driver-side files: JSON that is written atomically and read tolerantly, and exports of a payload."""

from __future__ import annotations

import json
import uuid
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame

from lodestone.operators.edits import write_atomically


def write_json(path: str | Path, value: object) -> None:
    write_atomically(Path(path), json.dumps(value, ensure_ascii=False, indent=2))


def read_json(path: str | Path) -> object | None:
    """The value, or None where the file is missing or is not JSON."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None


def export_payload(payloads: DataFrame, receipts: DataFrame, session_id: str, folder: str, now: datetime) -> tuple[Path, Path]:
    """Writes one session's payload as .md and its receipt as .json; the names hold time, hash and a random part."""
    row = payloads.where(payloads["session_id"] == session_id).join(receipts, "session_id").first()
    if row is None:
        raise ValueError(f"no payload for session {session_id}")
    name = f"{now:%Y%m%d-%H%M%S}-{row['content_sha256'][:8]}-{uuid.uuid4().hex[:8]}"
    text, receipt = Path(folder) / f"{name}.md", Path(folder) / f"{name}.json"
    write_atomically(text, row["text"])
    write_atomically(receipt, row["receipt"])
    return text, receipt
