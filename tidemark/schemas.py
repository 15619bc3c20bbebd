"""Types of the logical tables that the alignment operators take."""

from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    names = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(n, names[t]) for n, t in (x.split() for x in ddl.split(", "))])


MEDIA = _schema("media_id string, filepath string, duration double, fps double, fps_rational string, total_frames long, width int, height int, has_audio boolean, codec_name string, audio_codec string, audio_sample_rate int")
FRAMES = _schema("media_id string, frame_idx long, t double, h0 long, h1 long, lap_var double")
SIGNAL = _schema("media_id string, bin long, v double")
CUTS = _schema("media_id string, t double")
BLACKS = _schema("media_id string, b_start double, b_end double")
SAMPLES = _schema("pair_id long, target_t double, offset double, hd int")
SEGMENTS = _schema("pair_id long, seg_no int, target_start double, target_end double, offset double, phash_inliers int, phash_stdev double")

#: What a media probe prints, as far as it is read.
PROBE = T.StructType(
    [
        T.StructField("format", T.StructType([T.StructField("duration", T.StringType())])),
        T.StructField("streams", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("codec_type", "codec_name", "r_frame_rate", "nb_frames", "width", "height", "sample_rate", "duration")]))),
    ]
)
