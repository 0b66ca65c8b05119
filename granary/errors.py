"""Typed failures. Every one has a stable `kind`; `as_row` gives the columns of an error struct."""

from __future__ import annotations


class ArchiveError(Exception):
    kind = "internal"

    def __init__(self, detail: str = "", **fields: object) -> None:
        super().__init__(detail)
        self.detail = detail
        self.fields = fields

    def __getattr__(self, name: str) -> object:
        if name in ("fields", "__setstate__"):
            raise AttributeError(name)
        try:
            return self.fields[name]
        except KeyError:
            raise AttributeError(name) from None

    def __reduce__(self):
        return _again, (type(self), self.detail, self.fields)

    def as_row(self) -> dict[str, object]:
        get = self.fields.get
        return {"kind": self.kind, "detail": self.detail[:500], "scope": get("scope"), "feature": get("feature"), "method_id": get("method_id"), "limit": get("limit"), "requested": get("requested"), "maximum": get("maximum"), "member_index": get("member_index"), "expected": get("expected")}


def _again(cls: type, detail: str, fields: dict) -> ArchiveError:
    return cls(detail, **fields)


class FormatError(ArchiveError):
    """The bytes break a rule of their format."""

    kind = "format"


class ChecksumError(ArchiveError):
    """A declared check sum or digest doesn't match; `scope` names the layer."""

    kind = "checksum"


class UnsupportedMethodError(ArchiveError):
    """No decoder for `method_id` (hex)."""

    kind = "unsupported_method"


class UnsupportedFeatureError(ArchiveError):
    """Valid input that uses a part of the format that isn't read; `feature` is a stable token."""

    kind = "unsupported_feature"


class LimitExceededError(ArchiveError):
    """`limit` was asked for `requested`, over `maximum`."""

    kind = "limit_exceeded"


class MissingVolumeError(ArchiveError):
    """The part named `expected` isn't there."""

    kind = "missing_volume"


class PasswordRequiredError(ArchiveError):
    kind = "password_required"


class WrongPasswordOrCorruptError(ArchiveError):
    kind = "wrong_password_or_corrupt"


class CancelledError(ArchiveError):
    kind = "cancelled"


class ArchiveIoError(ArchiveError):
    kind = "io"


def unsupported(feature: str) -> UnsupportedFeatureError:
    return UnsupportedFeatureError(f"unsupported: {feature}", feature=feature)


def checksum(scope: str, member_index: int | None = None) -> ChecksumError:
    return ChecksumError(f"{scope} check sum mismatch", scope=scope, member_index=member_index)
