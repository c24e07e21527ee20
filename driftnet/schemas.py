"""Explicit schemas of the record types that flow through the pipeline."""

from __future__ import annotations

ARGS = "id:binary,target:binary,info_hash:binary,token:binary,port:int,implied_port:smallint"
REPLY = "id:binary,nodes:binary,nodes6:binary"
MESSAGE = f"t:binary,y:string,q:string,a:struct<{ARGS}>,r:struct<{REPLY}>"
INFO = "name:string,piece_length:long,total_size:long,files:array<struct<path:string,size:long>>"

#: Option names and defaults of a crawl.
OPTIONS = {
    "port": 6881, "metadata_timeout": 3, "max_metadata_queue_size": 100_000, "max_metadata_worker_count": 1000,
    "netmode": "v4", "node_queue_capacity": 100_000, "hash_queue_capacity": 10_000,
}
