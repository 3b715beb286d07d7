"""Processes and where they connect to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.fields import raw_data_value
from emberwatch.functions.text import first_filled
from emberwatch.operators.skew import once

#: Event ids of network connections and name lookups.
CONNECTION = 3
DNS_QUERY = 22


def field(*names: str) -> Column:
    """An event data value or the raw line's, the first name that has one; "" if none."""
    tries = [c for n in names for c in (F.element_at(F.col("eventData"), n), raw_data_value(F.col("rawLine"), n))]
    return F.coalesce(first_filled(*tries), F.lit(""))


def network_events(events: DataFrame, key: str) -> DataFrame:
    """Connection and lookup events with a process, their fields read once."""
    wanted = events.filter(F.col("eventId").isin(CONNECTION, DNS_QUERY))
    fields = F.struct(
        F.col(key).alias("key"),
        "eventId",
        "timestamp",
        field("ProcessGuid", "ProcessGUID").alias("guid"),
        field("Image").alias("image"),
        field("DestinationIp", "DestinationIP").alias("ip"),
        field("DestinationPort").alias("port"),
        field("DestinationHostname").alias("hostname"),
        field("Protocol").alias("protocol"),
        (field("Initiated") == "true").alias("initiated"),
        field("QueryName").alias("query"),
        field("QueryResults").alias("results"),
    )
    return once(wanted, fields, "_net").select("_net.*").filter(F.col("guid") != "")


def first_images(network: DataFrame) -> DataFrame:
    """The image of each process's first network event."""
    return network.groupBy("guid").agg(F.min_by("image", F.struct("timestamp", "key")).alias("image"))


def process_map(events: DataFrame, key: str) -> DataFrame:
    """Per process its image and how many connections and lookups it made, one row each."""
    network = network_events(events, key)
    totals = network.groupBy("guid").agg(
        F.count_if(F.col("eventId") == CONNECTION).alias("connections"),
        F.count_if(F.col("eventId") == DNS_QUERY).alias("lookups"),
        F.min_by("image", F.struct("timestamp", "key")).alias("image"),
    )
    return totals.select("guid", "image", "connections", "lookups")


def process_activity(events: DataFrame, key: str) -> DataFrame:
    """The connections and lookups behind the map, one row each, so that no list grows with a process."""
    return network_events(events, key).select(
        "guid",
        "key",
        "timestamp",
        F.when(F.col("eventId") == CONNECTION, F.lit("connection")).otherwise(F.lit("lookup")).alias("kind"),
        *(F.when(F.col("eventId") == CONNECTION, F.col(c)).alias(c) for c in ("ip", "port", "hostname", "protocol", "initiated")),
        *(F.when(F.col("eventId") == DNS_QUERY, F.col(c)).alias(c) for c in ("query", "results")),
    )


def destinations(events: DataFrame, key: str) -> DataFrame:
    """Per destination address its ports, number of images and connections, busiest first.

    Connections shrink to one row per (address, process, port) before the
    address groups form; the image is that of the process's first event.
    """
    network = network_events(events, key)
    counted = (
        network.filter((F.col("eventId") == CONNECTION) & (F.col("ip") != ""))
        .groupBy("ip", "port", "guid")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    named = counted.join(first_images(network), "guid").groupBy("ip", "port", "image").agg(F.sum("n").alias("n"))
    per_port = named.groupBy("ip", "port").agg(F.sum("n").alias("n"))
    images = named.groupBy("ip").agg(F.count_distinct("image").alias("processes"))
    # of the texts that the field may hold only port numbers are listed, 65536 at most
    is_port = F.col("port").rlike("^[0-9]{1,5}$") & (F.col("port").try_cast("int") <= 65535)
    ports = per_port.groupBy("ip").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(is_port, F.col("port").cast("int").cast("string")))), ", ").alias("ports"),
        F.sum("n").alias("connections"),
    )
    return ports.join(images, "ip").orderBy(F.col("connections").desc(), "ip")
