from .columns import cpio_kind, dos_timestamp, filetime_timestamp, kind_7z, safe_path, unix_mode_7z, unsafe_path_reason
from .rpm import named_tags, tag_map, tag_names
from .udtfs import register

__all__ = ["cpio_kind", "dos_timestamp", "filetime_timestamp", "kind_7z", "named_tags", "register", "safe_path", "tag_map", "tag_names", "unix_mode_7z", "unsafe_path_reason"]
