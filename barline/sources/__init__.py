"""Where series come from: landed vendor files and derived fixtures."""
