"""The task service: JSON and multipart bodies become request rows for run_stream(), over plain HTTP."""

from __future__ import annotations

import json
import os
import uuid
from datetime import UTC, datetime
from email import message_from_bytes
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

FIELDS = ("index_options", "callback_headers", "remote_file_headers")


class BadRequest(ValueError):
    """A body that is no task."""


def _mapping(value, name: str) -> dict:
    if value in (None, ""):
        return {}
    if isinstance(value, (str, bytes)):
        try:
            value = json.loads(value)
        except ValueError as e:
            raise BadRequest(f"{name} is no JSON: {e}") from e
    if not isinstance(value, dict):
        raise BadRequest(f"{name} must be a JSON object")
    return value


def parsed(content_type: str, body: bytes) -> dict:
    """task_id, callback_url, remote_file_url, file (name, content) and the mappings of a body; raises BadRequest."""
    if "multipart/form-data" in content_type:
        parts = message_from_bytes(f"Content-Type: {content_type}\r\n\r\n".encode() + body).get_payload()
        held = {"file": None}
        for part in parts if isinstance(parts, list) else []:
            name, data = part.get_param("name", header="content-disposition"), part.get_payload(decode=True) or b""
            held[name] = (part.get_filename() or "uploaded.bin", data) if name == "file" else data.decode()
    else:
        try:
            held = json.loads(body)
        except ValueError as e:
            raise BadRequest(f"the body is no JSON: {e}") from e
        if not isinstance(held, dict):
            raise BadRequest("the body must be a JSON object")
        held = {**held, "file": None}
    out = {k: held.get(k) or None for k in ("task_id", "callback_url", "remote_file_url", "file")}
    out |= {k: _mapping(held.get(k), k) for k in FIELDS}
    if not out["task_id"] or not out["callback_url"]:
        raise BadRequest("task_id and callback_url are required")
    if not out["file"] and not out["remote_file_url"]:
        raise BadRequest("a file or a remote file is required")
    if out["file"] and out["remote_file_url"]:
        raise BadRequest("a file and a remote file exclude each other")
    return out


def accepted(task: dict, requests: str) -> str:
    """Writes the task as a request file (and its upload beside) to the folder that run_stream() reads; the path."""
    path = None
    if task["file"]:
        folder = os.path.join(requests, "..", "uploads", uuid.uuid4().hex)
        os.makedirs(folder)
        path = os.path.abspath(os.path.join(folder, os.path.basename(task["file"][0])))
        with open(path, "wb") as f:
            f.write(task["file"][1])
    row = {"task_id": str(task["task_id"]), "callback_url": str(task["callback_url"]), "file_path": path, "remote_url": task["remote_file_url"], "index_options": json.dumps(task["index_options"]), "requested_at": datetime.now(UTC).isoformat()}
    os.makedirs(requests, exist_ok=True)
    at = os.path.join(requests, f"{uuid.uuid4().hex}.json")
    with open(at + ".part", "w", encoding="utf-8") as f:
        f.write(json.dumps(row))
    os.rename(at + ".part", at)
    return at


def server(requests: str, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """POST /tasks takes a task (202, or 400 with the reason); GET /healthz answers ok. serve_forever() starts it."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self.answer(*((200, {"status": "ok"}) if self.path == "/healthz" else (404, {"detail": "not found"})))

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if self.path != "/tasks":
                return self.answer(404, {"detail": "not found"})
            try:
                task = parsed(self.headers.get("Content-Type", ""), body)
            except BadRequest as e:
                return self.answer(400, {"detail": str(e)})
            accepted(task, requests)
            return self.answer(202, {"task_id": str(task["task_id"]), "status": "accepted"})

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
