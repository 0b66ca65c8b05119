"""One fixed schema for each table of each format. Rows of all tables begin with the archive's path."""

from __future__ import annotations

_SAFE = "is_safe_path boolean, unsafe_path_reason string"
_POSIX = "raw_name binary, name string, kind string, inode bigint, mode bigint, permissions bigint, uid bigint, gid bigint, link_count bigint, modified_time bigint, size bigint, device_major bigint, device_minor bigint, rdev_major bigint, rdev_minor bigint, checksum bigint, is_directory boolean, is_symlink boolean, " + _SAFE

ENTRIES: dict[str, str] = {
    "7z": "path string, idx bigint, raw_name array<int>, name string, kind string, has_stream boolean, is_empty_file boolean, is_anti_item boolean, size bigint, crc32 bigint, creation_time decimal(20,0), access_time decimal(20,0), modification_time decimal(20,0), windows_attributes bigint, start_position decimal(20,0), unix_mode bigint, is_symlink boolean, " + _SAFE + ", folder_index bigint, substream_index bigint",
    "zip": "path string, idx bigint, raw_name binary, name string, raw_comment binary, extra_fields binary, compression_method string, compression_method_id int, encryption string, aes_vendor_version int, aes_key_bits int, compressed_size bigint, size bigint, crc32 bigint, is_directory boolean, is_symlink boolean, unix_mode bigint, modified struct<year:int,month:int,day:int,hour:int,minute:int,second:int>, modified_time_raw int, modified_date_raw int, version_made_by int, version_needed int, flags int, internal_attributes int, external_attributes bigint, local_header_offset bigint, " + _SAFE,
    "cpio": "path string, idx bigint, format string, " + _POSIX,
    "rpm": "path string, idx bigint, " + _POSIX,
    "deb": "path string, idx bigint, section string, raw_name binary, name string, raw_link_name binary, kind string, mode bigint, permissions bigint, uid decimal(20,0), gid decimal(20,0), modified_time bigint, size bigint, user_name binary, group_name binary, device_major bigint, device_minor bigint, header_checksum bigint, " + _SAFE,
    "arj": "path string, idx bigint, raw_name binary, name string, raw_comment binary, archiver_version int, minimum_version int, host_os int, flags int, compression_method string, compression_method_id int, kind string, modified_time_raw bigint, compressed_size bigint, size bigint, crc32 bigint, file_spec_position int, access_mode int, is_encrypted boolean, " + _SAFE,
}

ARCHIVES: dict[str, str] = {
    "7z": "path string, sfx_offset bigint, major int, minor int, input_bytes bigint, entries bigint",
    "zip": "path string, comment binary, input_bytes bigint, entries bigint",
    "cpio": "path string, format string, input_bytes bigint, entries bigint",
    "rpm": "path string, lead_major int, lead_minor int, lead_type int, lead_architecture int, lead_name string, lead_os int, lead_signature_type int, payload_compression string, retained_payload_bytes bigint, input_bytes bigint, entries bigint",
    "deb": "path string, retained_control_bytes bigint, retained_data_bytes bigint, input_bytes bigint, entries bigint",
    "arj": "path string, raw_name binary, raw_comment binary, sfx_offset bigint, archiver_version int, minimum_version int, host_os int, flags int, created_time_raw bigint, modified_time_raw bigint, input_bytes bigint, entries bigint",
}

CONTENTS = "path string, idx bigint, name string, size bigint, content binary"
DEB_MEMBERS = "path string, idx bigint, raw_name binary, name string, kind string, compression string, modified_time bigint, uid bigint, gid bigint, mode bigint, size bigint"
RPM_TAGS = "path string, section string, position int, tag bigint, value_type string, ints array<decimal(20,0)>, bytes array<binary>"
FOLDERS_7Z = "path string, folder_index bigint, coders array<struct<method_id:binary,method:string,inputs:int,outputs:int,properties:binary>>, bind_pairs array<struct<input:int,output:int>>, packed_inputs array<int>, unpack_sizes array<bigint>, crc32 bigint, substreams bigint, is_encrypted boolean"
PACK_STREAMS_7Z = "path string, pack_index bigint, offset bigint, size bigint, crc32 bigint"
VERIFY = "path string, ok boolean, members bigint, output_bytes bigint"
STREAM_INFO = "path string, format string, compressed_size bigint, uncompressed_size bigint, frame_count bigint, skippable_frame_count bigint, content_checksum_frame_count bigint, block_checksum_frame_count bigint, dictionary_frame_count bigint, legacy_frame_count bigint, maximum_block_bytes bigint, maximum_window_bytes bigint, maximum_code_bits int, block_mode boolean, decoder_dictionary_bytes bigint"
STREAM_CONTENTS = "path string, format string, size bigint, frames_decoded bigint, checksums_verified bigint, content binary"
ERROR = "error struct<kind:string,detail:string,scope:string,feature:string,method_id:string,limit:string,requested:bigint,maximum:bigint,member_index:bigint,expected:string>"
