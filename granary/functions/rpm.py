"""RPM tags by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format. A tag without a name here keeps its number.
MAIN_TAGS = {
    61: "HEADERIMAGE", 62: "HEADERSIGNATURES", 63: "HEADERIMMUTABLE", 64: "HEADERREGIONS", 100: "HEADERI18NTABLE", 256: "SIG_BASE", 257: "SIGSIZE", 258: "SIGLEMD5_1",
    259: "SIGPGP", 260: "SIGLEMD5_2", 261: "SIGMD5", 262: "SIGGPG", 263: "SIGPGP5", 264: "BADSHA1_1", 265: "BADSHA1_2", 266: "PUBKEYS", 267: "SIGNATURE",
    268: "RSAHEADER", 269: "MD5", 270: "LONGSIGSIZE", 271: "LONGARCHIVESIZE", 273: "SHA256", 276: "VERITYSIGNATURES", 277: "VERITYSIGNATUREALGO", 1000: "NAME",
    1001: "VERSION", 1002: "RELEASE", 1003: "EPOCH", 1004: "SUMMARY", 1005: "DESCRIPTION", 1006: "BUILDTIME", 1007: "BUILDHOST", 1008: "INSTALLTIME", 1009: "SIZE",
    1010: "DISTRIBUTION", 1011: "VENDOR", 1012: "GIF", 1013: "XPM", 1014: "LICENSE", 1015: "PACKAGER", 1016: "GROUP", 1017: "CHANGELOG", 1018: "SOURCE", 1019: "PATCH",
    1020: "URL", 1021: "OS", 1022: "ARCH", 1023: "PREIN", 1024: "POSTIN", 1025: "PREUN", 1026: "POSTUN", 1027: "OLDFILENAMES", 1028: "FILESIZES", 1029: "FILESTATES",
    1030: "FILEMODES", 1031: "FILEUIDS", 1032: "FILEGIDS", 1033: "FILERDEVS", 1034: "FILEMTIMES", 1035: "FILEDIGESTS", 1036: "FILELINKTOS", 1037: "FILEFLAGS",
    1038: "ROOT", 1039: "FILEUSERNAME", 1040: "FILEGROUPNAME", 1041: "EXCLUDE", 1042: "EXCLUSIVE", 1043: "ICON", 1044: "SOURCERPM", 1045: "FILEVERIFYFLAGS",
    1046: "ARCHIVESIZE", 1047: "PROVIDENAME", 1048: "REQUIREFLAGS", 1049: "REQUIRENAME", 1050: "REQUIREVERSION", 1051: "NOSOURCE", 1052: "NOPATCH", 1053: "CONFLICTFLAGS",
    1054: "CONFLICTNAME", 1055: "CONFLICTVERSION", 1056: "DEFAULTPREFIX", 1057: "BUILDROOT", 1058: "INSTALLPREFIX", 1059: "EXCLUDEARCH", 1060: "EXCLUDEOS",
    1061: "EXCLUSIVEARCH", 1062: "EXCLUSIVEOS", 1063: "AUTOREQPROV", 1064: "RPMVERSION", 1065: "TRIGGERSCRIPTS", 1066: "TRIGGERNAME", 1067: "TRIGGERVERSION",
    1068: "TRIGGERFLAGS", 1069: "TRIGGERINDEX", 1079: "VERIFYSCRIPT", 1080: "CHANGELOGTIME", 1081: "CHANGELOGNAME", 1082: "CHANGELOGTEXT", 1084: "PREREQ",
    1085: "PREINPROG", 1086: "POSTINPROG", 1087: "PREUNPROG", 1088: "POSTUNPROG", 1089: "BUILDARCHS", 1090: "OBSOLETENAME", 1091: "VERIFYSCRIPTPROG",
    1092: "TRIGGERSCRIPTPROG", 1093: "DOCDIR", 1094: "COOKIE", 1095: "FILEDEVICES", 1096: "FILEINODES", 1097: "FILELANGS", 1098: "PREFIXES", 1099: "INSTPREFIXES",
    1100: "TRIGGERIN", 1101: "TRIGGERUN", 1102: "TRIGGERPOSTUN", 1103: "AUTOREQ", 1104: "AUTOPROV", 1105: "CAPABILITY", 1106: "SOURCEPACKAGE", 1107: "OLDORIGFILENAMES",
    1108: "BUILDPREREQ", 1109: "BUILDREQUIRES", 1110: "BUILDCONFLICTS", 1111: "BUILDMACROS", 1112: "PROVIDEFLAGS", 1113: "PROVIDEVERSION", 1114: "OBSOLETEFLAGS",
    1115: "OBSOLETEVERSION", 1116: "DIRINDEXES", 1117: "BASENAMES", 1118: "DIRNAMES", 1119: "ORIGDIRINDEXES", 1120: "ORIGBASENAMES", 1121: "ORIGDIRNAMES",
    1122: "OPTFLAGS", 1123: "DISTURL", 1124: "PAYLOADFORMAT", 1125: "PAYLOADCOMPRESSOR", 1126: "PAYLOADFLAGS", 1127: "INSTALLCOLOR", 1128: "INSTALLTID",
    1129: "REMOVETID", 1131: "RHNPLATFORM", 1132: "PLATFORM", 1133: "PATCHESNAME", 1134: "PATCHESFLAGS", 1135: "PATCHESVERSION", 1136: "CACHECTIME", 1137: "CACHEPKGPATH",
    1138: "CACHEPKGSIZE", 1139: "CACHEPKGMTIME", 1140: "FILECOLORS", 1141: "FILECLASS", 1142: "CLASSDICT", 1143: "FILEDEPENDSX", 1144: "FILEDEPENDSN",
    1145: "DEPENDSDICT", 1146: "SOURCEPKGID", 1147: "FILECONTEXTS", 1148: "FSCONTEXTS", 1149: "RECONTEXTS", 1150: "POLICIES", 1151: "PRETRANS", 1152: "POSTTRANS",
    1153: "PRETRANSPROG", 1154: "POSTTRANSPROG", 1155: "DISTTAG", 1156: "OLDSUGGESTSNAME", 1157: "OLDSUGGESTSVERSION", 1158: "OLDSUGGESTSFLAGS", 1159: "OLDENHANCESNAME",
    1160: "OLDENHANCESVERSION", 1161: "OLDENHANCESFLAGS", 1162: "PRIORITY", 1163: "CVSID", 1164: "BLINKPKGID", 1165: "BLINKHDRID", 1166: "BLINKNEVRA", 1167: "FLINKPKGID",
    1168: "FLINKHDRID", 1169: "FLINKNEVRA", 1170: "PACKAGEORIGIN", 1171: "TRIGGERPREIN", 1172: "BUILDSUGGESTS", 1173: "BUILDENHANCES", 1174: "SCRIPTSTATES",
    1175: "SCRIPTMETRICS", 1176: "BUILDCPUCLOCK", 1177: "FILEDIGESTALGOS", 1178: "VARIANTS", 1179: "XMAJOR", 1180: "XMINOR", 1181: "REPOTAG", 1182: "KEYWORDS",
    1183: "BUILDPLATFORMS", 1184: "PACKAGECOLOR", 1185: "PACKAGEPREFCOLOR", 1186: "XATTRSDICT", 1187: "FILEXATTRSX", 1188: "DEPATTRSDICT", 1189: "CONFLICTATTRSX",
    1190: "OBSOLETEATTRSX", 1191: "PROVIDEATTRSX", 1192: "REQUIREATTRSX", 1193: "BUILDPROVIDES", 1194: "BUILDOBSOLETES", 1195: "DBINSTANCE", 1196: "NVRA",
    5000: "FILENAMES", 5001: "FILEPROVIDE", 5002: "FILEREQUIRE", 5003: "FSNAMES", 5004: "FSSIZES", 5005: "TRIGGERCONDS", 5006: "TRIGGERTYPE", 5007: "ORIGFILENAMES",
    5008: "LONGFILESIZES", 5009: "LONGSIZE", 5010: "FILECAPS", 5011: "FILEDIGESTALGO", 5012: "BUGURL", 5013: "EVR", 5014: "NVR", 5015: "NEVR", 5016: "NEVRA",
    5017: "HEADERCOLOR", 5018: "VERBOSE", 5019: "EPOCHNUM", 5020: "PREINFLAGS", 5021: "POSTINFLAGS", 5022: "PREUNFLAGS", 5023: "POSTUNFLAGS", 5024: "PRETRANSFLAGS",
    5025: "POSTTRANSFLAGS", 5026: "VERIFYSCRIPTFLAGS", 5027: "TRIGGERSCRIPTFLAGS", 5029: "COLLECTIONS", 5030: "POLICYNAMES", 5031: "POLICYTYPES",
    5032: "POLICYTYPESINDEXES", 5033: "POLICYFLAGS", 5034: "VCS", 5035: "ORDERNAME", 5036: "ORDERVERSION", 5037: "ORDERFLAGS", 5038: "MSSFMANIFEST", 5039: "MSSFDOMAIN",
    5040: "INSTFILENAMES", 5041: "REQUIRENEVRS", 5042: "PROVIDENEVRS", 5043: "OBSOLETENEVRS", 5044: "CONFLICTNEVRS", 5045: "FILENLINKS", 5046: "RECOMMENDNAME",
    5047: "RECOMMENDVERSION", 5048: "RECOMMENDFLAGS", 5049: "SUGGESTNAME", 5050: "SUGGESTVERSION", 5051: "SUGGESTFLAGS", 5052: "SUPPLEMENTNAME",
    5053: "SUPPLEMENTVERSION", 5054: "SUPPLEMENTFLAGS", 5055: "ENHANCENAME", 5056: "ENHANCEVERSION", 5057: "ENHANCEFLAGS", 5058: "RECOMMENDNEVRS", 5059: "SUGGESTNEVRS",
    5060: "SUPPLEMENTNEVRS", 5061: "ENHANCENEVRS", 5062: "ENCODING", 5063: "FILETRIGGERIN", 5064: "FILETRIGGERUN", 5065: "FILETRIGGERPOSTUN", 5066: "FILETRIGGERSCRIPTS",
    5067: "FILETRIGGERSCRIPTPROG", 5068: "FILETRIGGERSCRIPTFLAGS", 5069: "FILETRIGGERNAME", 5070: "FILETRIGGERINDEX", 5071: "FILETRIGGERVERSION",
    5072: "FILETRIGGERFLAGS", 5073: "TRANSFILETRIGGERIN", 5074: "TRANSFILETRIGGERUN", 5075: "TRANSFILETRIGGERPOSTUN", 5076: "TRANSFILETRIGGERSCRIPTS",
    5077: "TRANSFILETRIGGERSCRIPTPROG", 5078: "TRANSFILETRIGGERSCRIPTFLAGS", 5079: "TRANSFILETRIGGERNAME", 5080: "TRANSFILETRIGGERINDEX", 5081: "TRANSFILETRIGGERVERSION",
    5082: "TRANSFILETRIGGERFLAGS", 5083: "REMOVEPATHPOSTFIXES", 5084: "FILETRIGGERPRIORITIES", 5085: "TRANSFILETRIGGERPRIORITIES", 5086: "FILETRIGGERCONDS",
    5087: "FILETRIGGERTYPE", 5088: "TRANSFILETRIGGERCONDS", 5089: "TRANSFILETRIGGERTYPE", 5090: "FILESIGNATURES", 5091: "FILESIGNATURELENGTH", 5092: "PAYLOADDIGEST",
    5093: "PAYLOADDIGESTALGO", 5094: "AUTOINSTALLED", 5095: "IDENTITY", 5096: "MODULARITYLABEL", 5097: "PAYLOADDIGESTALT", 5098: "ARCHSUFFIX", 5099: "SPEC",
    5100: "TRANSLATIONURL", 5101: "UPSTREAMRELEASES", 5102: "SOURCELICENSE", 5103: "PREUNTRANS", 5104: "POSTUNTRANS", 5105: "PREUNTRANSPROG", 5106: "POSTUNTRANSPROG",
    5107: "PREUNTRANSFLAGS", 5108: "POSTUNTRANSFLAGS", 5109: "SYSUSERS",
}
SIGNATURE_TAGS = {
    61: "HEADERIMAGE", 62: "HEADERSIGNATURES", 257: "SIZE", 259: "PGP", 260: "MD5", 262: "GPG", 264: "BADSHA1_1", 265: "BADSHA1_2", 267: "DSA", 268: "RSA", 269: "SHA1",
    270: "LONGSIZE", 271: "LONGARCHIVESIZE", 273: "SHA256", 274: "FILESIGNATURES", 275: "FILESIGNATURELENGTH", 276: "VERITYSIGNATURES", 277: "VERITYSIGNATUREALGO",
    1000: "SIZE", 1001: "LEMD5_1", 1002: "PGP", 1003: "LEMD5_2", 1004: "MD5", 1005: "GPG", 1006: "PGP5", 1007: "PAYLOADSIZE", 1008: "RESERVEDSPACE",
}


def tag_names(spark: SparkSession) -> DataFrame:
    """section, tag, tag_name."""
    rows = [(s, t, n) for s, names in (("main", MAIN_TAGS), ("signature", SIGNATURE_TAGS)) for t, n in names.items()]
    return spark.createDataFrame(rows, "section string, tag long, tag_name string")


def _texts(b: Column) -> Column:
    return F.transform(b, lambda x: F.decode(x, "UTF-8"))


def tag_map(tags: DataFrame) -> DataFrame:
    """path, section, tags: a map from number to value for each header; of a duplicate the last counts."""
    value = F.struct("value_type", "ints", "bytes")
    last = tags.groupBy("path", "section", "tag").agg(F.max_by(value, "position").alias("value"))
    return last.groupBy("path", "section").agg(F.map_from_entries(F.collect_list(F.struct("tag", "value"))).alias("tags"))


def named_tags(tags: DataFrame) -> DataFrame:
    """path, section, tag_name, ints, texts of the tags, one without a known name under its number: the last of duplicates, and of a translated
    string the first language alone."""
    last = tags.groupBy("path", "section", "tag").agg(F.max_by(F.struct("value_type", "ints", "bytes"), "position").alias("v"))
    named = last.join(F.broadcast(tag_names(tags.sparkSession)), ["section", "tag"], "left").withColumn("tag_name", F.coalesce("tag_name", F.col("tag").cast("string")))  # fixed size
    held = F.when(F.col("v.value_type") == "i18n_string", F.slice("v.bytes", 1, 1)).otherwise(F.col("v.bytes"))
    return named.select("path", "section", "tag_name", "v.ints", F.when(F.col("v.value_type").isin("string", "string_array", "i18n_string"), _texts(held)).otherwise(F.array().cast("array<string>")).alias("texts"))
