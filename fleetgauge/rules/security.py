"""Security rules."""

from __future__ import annotations

from ..functions.text import list_items_sql
from .model import Case, Rule, rule

C = "security"
# The first entry of the policy is the default plugin; `*` leaves it open.
POLICY = list_items_sql("{fold.authentication_policy}") + "[0]"

SECURITY_RULES = (
    rule("local_infile", C, "warn", "{fold.local_infile} = 'on'",
         "LOAD DATA LOCAL is allowed, which a hostile server or client can use to read files."),
    rule("skip_name_resolve", C, "note", "{fold.skip_name_resolve} = 'off'",
         "Each new connection waits for a name lookup, and fails when the name service does."),
    rule("require_secure_transport", C, "note", "{fold.require_secure_transport} = 'off'",
         "Clients may connect without TLS."),
    rule("sql_mode_strict", C, "warn", "{text.sql_mode} <> '' AND NOT contains({fold.sql_mode}, 'strict_trans_tables')",
         "Without STRICT_TRANS_TABLES values are cut or replaced silently instead of being refused.",
         variable="sql_mode"),
    rule("sql_mode_no_engine_sub", C, "note", "{text.sql_mode} <> '' AND NOT contains({fold.sql_mode}, 'no_engine_substitution')",
         "Without NO_ENGINE_SUBSTITUTION a table may silently get another engine.", variable="sql_mode"),
    Rule("default_authentication_plugin", C, "note", (
        Case(f"{{text.authentication_policy}} <> '' AND {POLICY} NOT IN ('*', 'caching_sha2_password')",
             "authentication_policy",
             "The authentication policy begins with a plugin weaker than caching_sha2_password."),
        Case("{text.authentication_policy} = ''"
             " AND {fold.default_authentication_plugin} NOT IN ('', 'caching_sha2_password')",
             "default_authentication_plugin",
             "New accounts get a plugin weaker than caching_sha2_password."),
    )),
    rule("tls_version", C, "warn",
         f"arrays_overlap({list_items_sql('{text.tls_version}')}, array('TLSv1', 'TLSv1.1'))",
         "TLS 1.0 or 1.1 is accepted; both are withdrawn, allow 1.2 and 1.3 only."),
)
