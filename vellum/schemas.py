"""Declared schemas of the flat tables and of the nested page documents."""

from __future__ import annotations

from pyspark.sql import types as T

POINTS = T.ArrayType(T.ArrayType(T.IntegerType()))


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


METADATA = _struct(created=T.StringType(), creator=T.StringType(), comments=T.StringType())
PAGE = _struct(page_id=T.StringType(), image_filename=T.StringType(), image_width=T.IntegerType(), image_height=T.IntegerType(), type=T.StringType(), text_direction=T.StringType(), metadata=METADATA)
REGION = _struct(page_id=T.StringType(), region_id=T.StringType(), region_pos=T.IntegerType(), parent_ids=T.ArrayType(T.StringType()), coords=POINTS)
LINE = _struct(page_id=T.StringType(), line_id=T.StringType(), line_pos=T.IntegerType(), region_ids=T.ArrayType(T.StringType()), coords=POINTS, baseline=POINTS, centerline=POINTS, x_height=T.IntegerType(), text=T.StringType(), custom=T.StringType())
MASKS = T.ArrayType(_struct(off=T.IntegerType(), len=T.IntegerType()))
SAMPLE = _struct(sample_id=T.StringType(), width=T.IntegerType(), height=T.IntegerType(), transcription=T.StringType(), expansion_masks=MASKS, channel=T.StringType())

#: One line as it stands inside a page document; `regions` goes from the outermost region to the innermost.
DOCUMENT_LINE = T.StructType([T.StructField(k, v) for k, v in {"id": T.StringType(), "baseline": POINTS, "coords": POINTS, "centerline": POINTS, "x-height": T.IntegerType(), "regions": T.ArrayType(T.StringType()), "text": T.StringType(), "custom": T.StringType()}.items()])
DOCUMENT_REGION = _struct(id=T.StringType(), coords=POINTS, lines=T.ArrayType(DOCUMENT_LINE))
#: A page document, with lines at the top, inside regions, or both.
DOCUMENT = _struct(metadata=METADATA, type=T.StringType(), text_direction=T.StringType(), image_filename=T.StringType(), image_width=T.IntegerType(), image_height=T.IntegerType(), lines=T.ArrayType(DOCUMENT_LINE), regions=T.ArrayType(DOCUMENT_REGION))
RESOURCE = _struct(url=T.StringType(), file=T.StringType(), tarball_filename=T.StringType(), md5=T.StringType(), **{"full-md5": T.StringType()}, desc=T.StringType(), origin=T.StringType(), tarball_root_name=T.StringType(), comment=T.StringType())
LAYOUT_APP = _struct(class_names=T.ArrayType(T.StringType()), rect_classes=T.ArrayType(T.IntegerType()), rect_LTRB=T.ArrayType(T.ArrayType(T.IntegerType())))
EPOCH = _struct(epoch=T.IntegerType(), loss=T.DoubleType(), cer=T.DoubleType(), wer=T.DoubleType(), lr=T.DoubleType(), duration=T.DoubleType())
