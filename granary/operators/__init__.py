from .tables import archives, assemble_volumes, contents, deb_member_contents, deb_members, entries, folders_7z, members, pack_streams_7z, rpm_tags, stream_info, symlink_targets, unpack_streams, verify

__all__ = ["archives", "assemble_volumes", "contents", "deb_member_contents", "deb_members", "entries", "folders_7z", "members", "pack_streams_7z", "rpm_tags", "stream_info", "symlink_targets", "unpack_streams", "verify"]
