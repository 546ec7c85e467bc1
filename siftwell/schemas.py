"""Fixed schemas of the stored tables and of search results."""

from pyspark.sql.types import StructType


def _struct(spec: str) -> StructType:
    """A schema from ``name type`` pairs, without a session."""
    from pyspark.sql import types as T

    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "vector": T.ArrayType(T.FloatType()), "binary": T.BinaryType()}
    return StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split() for x in spec.split(","))])


FILES = _struct("file_id long,file_path string,content_hash string,file_size_bytes long,last_modified_os timestamp,last_indexed_at timestamp")
CHUNKS = _struct("chunk_id long,file_id long,label long,chunk_text string,start_char_offset int,end_char_offset int,token_count int,embedding vector")
KEY_VALUES = _struct("key string,value string")
PROJECTS = _struct("project_id long,project_name string,store_path string,embedding_model_name string")
PROJECT_PATHS = _struct("project_id long,path string")
RESULTS = _struct("label long,score double,file_path string,chunk_text string,start_char_offset int,end_char_offset int")
