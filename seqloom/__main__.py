from seqloom.cli import main

raise SystemExit(main())
