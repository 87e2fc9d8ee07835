"""Tables in and out: file discovery, layer catalog, project index, exports."""
