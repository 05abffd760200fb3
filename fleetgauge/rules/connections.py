"""Connection rules. Numbers are fixed values."""

from __future__ import annotations

from .model import rule

C = "connections"

CONNECTION_RULES = (
    rule("max_connections", C, "note", "{int.max_connections} > 1000",
         "More than 1000 connections are allowed; check that they are needed."),
    rule("max_connections_critical", C, "critical", "{int.max_connections} > 5000",
         "More than 5000 connections are allowed, enough to use up the memory of the host.",
         variable="max_connections"),
    rule("thread_cache_size", C, "warn", "{text.thread_cache_size} = '0'",
         "Every connection starts a new thread; keep at least 8 to 16 in the cache."),
    rule("wait_timeout_high", C, "note", "{int.wait_timeout} > 28800",
         "Idle connections live longer than eight hours, with their resources and locks.", variable="wait_timeout"),
    rule("wait_timeout_low", C, "warn", "{int.wait_timeout} < 60",
         "Connections that are idle for less than a minute are cut, working clients among them.",
         variable="wait_timeout"),
    rule("interactive_timeout", C, "note",
         "{has.interactive_timeout} AND {has.wait_timeout} AND {text.interactive_timeout} <> {text.wait_timeout}",
         "Interactive and other sessions time out differently, which is seldom meant."),
    rule("max_connect_errors", C, "note", "{int.max_connect_errors} < 100000",
         "A few network faults are enough to block a host; allow 100000 errors or more."),
    rule("connect_timeout", C, "note", "{int.connect_timeout} > 30",
         "Handshakes may take more than 30 seconds, which slow clients can use to bind resources."),
    rule("max_allowed_packet", C, "note", "{int.max_allowed_packet} < 67108864",
         "Packets are limited to less than 64 MB; large rows and statements will fail."),
)
