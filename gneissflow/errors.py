"""The one exception of the request path, with its codes and exit codes."""

from __future__ import annotations

#: Codes and process exit codes.
EXIT = {
    "USAGE": 2, "REQUEST_INVALID": 2, "REQUEST_READ_FAILED": 2, "REQUEST_TOO_LARGE": 2, "PROTOCOL_UNSUPPORTED": 2, "BUDGET_TOO_SMALL": 2,
    "ANALYSIS_TARGET_REQUIRED": 2, "WORKSPACE_INVALID": 1, "SOURCE_CHANGED": 1, "INTERNAL": 1,
}


class EngineError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.message, self.exit_code = code, message, EXIT[code]

    def as_dict(self) -> dict:
        return {"error": {"code": self.code, "message": self.message}}
