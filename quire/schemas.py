"""Fixed column names and schemas.  CSV readers bind each file to its own
header (``sources.csv_rows``); JSON is read with the schemas below."""

from pyspark.sql import types as T

# Metadata columns of note files, in the files' order.
NOTE_META = ["note_id", "subject_id", "hadm_id", "note_type", "note_seq",
             "charttime", "storetime"]
# Fields of a patient record, in the records' order.
PATIENT_FIELDS = ["arrival", "triage", "codes", "vitals", "pyxis", "medrecon",
                  "eddischarge", "admission", "discharge", "eddischarge_category"]
PATIENT_STRUCT = T.StructType([T.StructField(c, T.StringType()) for c in PATIENT_FIELDS])
PATIENT_LINES_SCHEMA = T.StructType(
    [T.StructField("patient_id", T.StringType())] + list(PATIENT_STRUCT.fields))

# The six corpus sources in union order.
SOURCE_ORDER = ["discharge", "radiology", "articles", "diagnosis", "procedure", "hcpcs"]
