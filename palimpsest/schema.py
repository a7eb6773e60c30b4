"""Column types shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.options import SECTIONS

RUN = ("struct<t:string,b:boolean,i:boolean,u:boolean,s:boolean,sz:double,"
       "color:string,hl:string,font:string,img:string>")
CELLS = f"array<array<{RUN}>>"
STYLE = "struct<b:boolean,i:boolean,u:boolean,s:boolean,sz:double,color:string,hl:string,font:string>"
TOKEN = f"struct<t:string,key:bigint,ws:boolean,sep:boolean,psep:boolean,c:int,blk:int,st:{STYLE}>"


def sec_ord(sec: Column) -> Column:
    """0..3 for header, body, footnote, footer; a missing section is the body."""
    out = F.when(sec == SECTIONS[0], 0)
    for i, name in enumerate(SECTIONS[1:], start=1):
        out = out.when(sec == name, i)
    return out.otherwise(1)


def run(t: Column, **style: Column) -> Column:
    """A run struct with the given text and style fields; the others are null."""
    types = {"b": "boolean", "i": "boolean", "u": "boolean", "s": "boolean", "sz": "double",
             "color": "string", "hl": "string", "font": "string", "img": "string"}
    fields = [t.cast("string").alias("t")]
    for name, typ in types.items():
        fields.append(style.get(name, F.lit(None)).cast(typ).alias(name))
    return F.struct(*fields)
