from .files import read_archives
from .datasource import ArchiveSource, register

__all__ = ["ArchiveSource", "read_archives", "register"]
