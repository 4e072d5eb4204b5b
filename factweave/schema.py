"""Schemas of the relations, and the rules by which documents are gated."""

from __future__ import annotations

IR_DOCUMENT = """functions ARRAY<STRUCT<name: STRING, owner: STRING, library_uri: STRING, address: STRING, size: BIGINT, kind: STRING,
 instructions: ARRAY<STRUCT<mnemonic: STRING, object_pool_value: STRING>>,
 semantic_statements: ARRAY<STRUCT<kind: STRING>>,
 control_flow: ARRAY<STRUCT<`from`: STRING, `to`: STRING, kind: STRING>>>>,
 vm_oracle STRUCT<snapshot_hash: STRING, dart_commit: STRING, target_arch: STRING>"""

TRACE = """`schema` STRING, abi STRING, snapshot_hash STRING,
 executed_pcs ARRAY<STRUCT<body_entry_offset: BIGINT, pc_offset: BIGINT, hit_count: BIGINT>>,
 receiver_cids ARRAY<STRUCT<call_site_pc_offset: BIGINT, class_id: BIGINT, hit_count: BIGINT>>,
 dispatch_targets ARRAY<STRUCT<selector_index: BIGINT, target_offset: BIGINT, hit_count: BIGINT>>,
 argument_descriptors ARRAY<STRUCT<callee_offset: BIGINT, positional_count: BIGINT, named_names: ARRAY<STRING>, hit_count: BIGINT>>"""

OBSERVATION = """abi STRING, library_uri STRING, owner STRING, member STRING, lexical_index BIGINT, fixed BIGINT, optional BIGINT,
 parent_lexical BIGINT, ambiguous_abi STRING, constants ARRAY<BIGINT>, callees ARRAY<STRING>, pool_identities ARRAY<STRING>"""
